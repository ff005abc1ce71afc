import random

import pytest
from pyspark.sql import functions as F

from quillspark.llm import encoding, mixing, personal, quality, scans, splitting, tokens

LONG = "First the kettle opened a quiet drawer, then Marholm folded the schedule. "


def naive_cuts(text, limit, overlap):
    b = splitting.Boundaries(text)
    out, a = [], 0
    while True:
        start = a - min(overlap, a)
        if b.n - start <= limit:
            return out
        far = start + limit
        a = next((int(last[far]) for last in b.last if last[far] > a), far)
        out.append(a)


@pytest.mark.parametrize("seed", range(12))
def test_cuts_equal_a_loop(seed):
    rng = random.Random(seed)
    parts = []
    for _ in range(rng.randrange(50, 900)):
        parts.append(rng.choice(["word", "Rs.", "end.", "e.g.", "3.14", 'said."', "what?", "x"]) + rng.choice([" ", " ", " ", "\n", "\n\n", "\r\n \r\n", "\f", "\t"]))
    text = "".join(parts)
    for limit, overlap in ((350, 60), (40, 10), (7, 3)):
        got, b = splitting.cut_words(text, limit, overlap)
        assert got == naive_cuts(text, limit, overlap)
        for a, e in zip([0, *got], [*got, b.n]):
            assert e > a and e - (a - min(overlap, a)) <= limit


def test_boundaries():
    b = splitting.Boundaries("Costs Rs. 5 e.g. now. Next (end.) 7.5 x\ny\n\nz\fq")
    n = b.n
    assert [k for k in range(n + 1) if b.last[0][k] == k and k] == [10, 11]
    assert [k for k in range(n + 1) if b.last[1][k] == k and k] == [5, 7]
    assert b.last[2][9] == 9


def test_pieces_are_numbered_in_order_and_keep_pages(spark):
    rows = [("b", "A", 1, 7, LONG * 60), ("a", "A", 0, None, "short"), ("c", "A", 2, 8, "last"), ("d", "B", 0, 1, ""), ("e", "B", 1, 1, None), ("b", "A", 1, 7, LONG * 60), ("f", None, 0, 1, "x")]
    df = spark.createDataFrame(rows, "id string, asset_id string, chunk_index int, page_number int, text string").withColumn("piece", F.lit("clash"))
    got = splitting.pieces(df).where("asset_id = 'A'").orderBy("chunk_index").collect()
    assert [r["chunk_index"] for r in got] == list(range(len(got))) and got[0]["id"] == "a" and got[-1]["id"] == "c"
    own = [r for r in got if r["id"] == "b"]
    assert len(own) > 2 and all(r["page_number"] == 7 and len(r["text"].split()) <= 350 for r in own)
    assert own[1]["text"].split()[:60] == own[0]["text"].split()[-60:]
    assert {r["cut_word"] for r in splitting.cuts(df).collect()} == set(splitting.cut_words(LONG * 60)[0])
    assert splitting.cuts(df.where("false")).count() == 0


CLEAN = {
    "fr": "La fête a été payé à midi, après la pause le chèque reste fermé. Très tôt la forêt coûte trop cher pendant l'été.",
    "de": "Für zwei Tage blieb die Küche geöffnet; der Schlüssel lag im Flur. Bei schönem Wetter fiel die Lüftung auf, große Straße.",
    "pl": "Książka leży na półce w październiku. Późną nocą źródło było drogie, całą zimę łóżko wróciło później.",
    "ru": "Поезд пришёл поздно, вокзал нужно проверить. После обеда лестница стоит дорого, чемодан всем понравился.",
    "en": "We paid £29 for the piñata – the entrée wasn’t late enough. It’s “solemn”, the sensor said — the façade cost €5… at 23 °C",
}


@pytest.fixture(scope="module")
def repairer():
    return encoding.Repairer({k: (v * 3).encode() for k, v in CLEAN.items()})


@pytest.mark.parametrize("lang", CLEAN)
@pytest.mark.parametrize("codec", ("latin-1", "cp437", "mac_roman", "cp850"))
def test_utf8_misread_is_restored(repairer, lang, codec):
    text = CLEAN[lang]
    bad = text.encode().decode(codec)
    assert repairer.repair(bad) == text
    half = len(text) // 2
    assert repairer.repair(text[:half] + " " + text[half:].encode().decode(codec)) == text[:half] + " " + text[half:]


def test_twice_misread_and_one_byte_swaps(repairer):
    text = CLEAN["fr"]
    assert repairer.repair(text.encode().decode("latin-1").encode().decode("latin-1")) == text
    ru = CLEAN["ru"]
    assert repairer.repair(ru.encode("cp1251").decode("latin-1")) == ru
    assert repairer.repair(ru.encode("koi8-r").decode("cp1251")) == ru


@pytest.mark.parametrize("text", [*CLEAN.values(), "Â × √2 ≈ 1.41 ©", "├── café ™", "Größe: 12 µm ± 3 %", "CÂMARA N.º 4 —", ""])
def test_sound_texts_stay(repairer, text):
    assert repairer.repair(text) == text


def test_garbled_rows(spark):
    bad = CLEAN["fr"].encode().decode("latin-1")
    rows = [("a", bad), ("a", bad), ("b", "lost � here"), ("c", CLEAN["fr"]), ("d", None), ("e", ""), ("f", (bad + " ") * 400)]
    df = spark.createDataFrame(rows, "id string, text string").withColumn("lost", F.lit("clash"))
    got = {r["id"]: r for r in encoding.find_garbled(df, {"fr": CLEAN["fr"].encode()}).collect()}
    assert got.keys() == {"a", "b", "f"} and got["a"]["restored"] == CLEAN["fr"] and got["b"]["lost"] == 1 and got["f"]["lost"] == 0
    assert encoding.find_garbled(df.where("false"), {}).count() == 0
    docs = spark.createDataFrame([(k, "fr", CLEAN["fr"] * 2) for k in range(5)] + [(9, None, "x"), (10, "fr", None)], "doc_id long, lang string, text string")
    assert list(encoding.train(docs)) == ["fr"] and encoding.train(docs.where("false")) == {}


PII = [
    ("Contact: Brodan Ulmoenko. Ring +1 312 555 0149 and ask.", {("person_name", "Brodan Ulmoenko"), ("phone", "+1 312 555 0149")}),
    ("Guest name - Zelmira Sorbinmann; nights: 17.", {("person_name", "Zelmira Sorbinmann")}),
    ("Passenger Quistasson, L has seat 2A.", {("person_name", "Quistasson, L")}),
    ("Mrs I. Sorbawell called about the proposal.", {("person_name", "I. Sorbawell")}),
    ("Mail bremomann231@brake.invalid or yaina [at] receipt [dot] test; no more.", {("email", "bremomann231@brake.invalid"), ("email", "yaina [at] receipt [dot] test")}),
    ("My aunt moved to Flat 14A, 13 Weaverenfield Terrace, Drenihaven QX4 4ZZ with her backup.", {("address", "Flat 14A, 13 Weaverenfield Terrace, Drenihaven QX4 4ZZ")}),
    ("Billing to P.O. Box 42, Marimead 38241, same as the payment.", {("address", "P.O. Box 42, Marimead 38241")}),
    ("Passport or card no. X00366661, shown at the table.", {("id_number", "X00366661")}),
    ("Parcel 4417 5932 8342 left the depot. Lot number 708-74-477 is on the ferry. Gate 58 Lane 20 leads to it. The Luniwick Winter Fair opens in hall 30.", set()),
]


def test_mentions_and_placeholders(spark):
    rows = [(f"{k}-{n}", t) for k in range(12) for n, (t, _) in enumerate(PII)] + [("null", None), ("empty", ""), ("0-0", PII[0][0])]
    df = spark.createDataFrame(rows, "id string, text string").withColumn("kind", F.lit(1))
    finder, spans = personal.train(df)
    got = {}
    for r in personal.mentions(finder, spans).collect():
        got.setdefault(r["id"], set()).add((r["kind"], r["found_value"]))
    for n, (_, want) in enumerate(PII):
        assert got.get(f"3-{n}", set()) == want
    clean = {r["id"]: r["text"] for r in personal.redacted(df, finder).collect()}
    assert clean["0-0"] == "Contact: [PERSON_NAME]. Ring [PHONE] and ask." and "0-8" not in clean
    empty = df.where("false")
    assert personal.mentions(*personal.train(empty)).count() == 0


def test_scan_faults_and_repair(spark):
    body = "The warranty on this well-known portrait ends soon. Children remembered the self-catering pharmacy near the photograph of the western lounge. "
    page = lambda k, mark: f"Dinner notes 6{k}\n{[0, "First", "The"][k]} war-\nranty on this we11-known por¬\ntrait ends soon. Children rernembered the self-\ncatering pharmacy near\n90\nthe photograph of the wes-\ntern {mark}.\nPage {k} of 8"
    rows = [(f"t{k}", "B", 1, body, None) for k in range(4)] + [("p1", "A", 1, page(1, "lounge"), "ocr:1"), ("p2", "A", 2, page(2, "l0unge"), "OCR:2"), ("p2", "A", 2, page(2, "l0unge"), "OCR:2"), ("p3", "A", None, None, "ocr:3"), ("p4", None, 1, "", "ocr:1")]
    df = spark.createDataFrame(rows, "id string, asset_id string, page_number int, text string, source string").withColumn("keys", F.lit("clash"))
    got = {}
    for r in scans.faults(df).collect():
        got.setdefault((r["id"], r["kind"]), set()).add(r["found_value"])
    assert got["p2", "running_line"] == {"Dinner notes 62"} and got["p2", "page_number"] == {"Page 2 of 8"}
    assert got["p2", "broken_word"] == {"warranty", "portrait", "self-catering", "western"}
    assert got["p2", "misread"] == {"well-known", "remembered", "lounge"}
    fixed = {r["id"]: r["text"] for r in scans.repaired(df).collect()}
    assert fixed["p2"].startswith("The warranty on this well-known portrait ends soon. Children remembered the self-catering pharmacy") and "\n" not in fixed["p2"]
    assert scans.faults(df.where("false")).count() == 0


LEXICON = {w: 20 for w in "photograph of western lounge warranty remembered pharmacy near portrait ends soon children well-known self-catering schedule mustard on this a in".split()} | {"the": 400}


@pytest.mark.parametrize(
    "text, fixed, broken, misread",
    [
        ("The pho tograph of the wes tern lounge", "The photograph of the western lounge", [], []),
        ("near\nthewarranty rem embered", "near\nthe warranty remembered", [], []),
        ("the phar\nmacy ends", "the pharmacy ends", ["pharmacy"], []),
        ("pho to\ngraph wes ter-\nn", "photograph western", ["photograph", "western"], []),
        ("the we11-known self-\ncatering por¬\ntrait, soon", "the well-known self-catering portrait, soon", ["self-catering", "portrait"], ["well-known"]),
        ("rernembered,thewestern Lounge", "remembered,the western Lounge", [], ["remembered"]),
        ("pho t0graph blue-w3stern", "photograph blue-western", [], ["photograph", "blue-western"]),
        ("Mar-\nhaven Quistavale", "Marhaven Quistavale", ["Marhaven"], []),
        ("the lounge-\n", "the lounge-\n", [], []),
        ("-", "-", [], []),
        ("", "", [], []),
    ],
)
def test_splits_merges_hyphens_and_confusions_are_decoded_together(text, fixed, broken, misread):
    lines, b, m = scans.read_body(text.split("\n"), scans.Decoder(LEXICON))
    assert ("\n".join(lines), b, m) == (fixed, broken, misread)


@pytest.mark.parametrize("seed", range(10))
def test_damaged_streams_are_restored(seed):
    rng = random.Random(seed)
    decoder, words = scans.Decoder(LEXICON), [w for w in LEXICON if len(w) > 5 and "-" not in w]
    good = total = 0
    for _ in range(40):
        row = [rng.choice(words) for _ in range(6)]
        k = rng.randrange(1, 5)
        cut = rng.randrange(2, len(row[k]) - 2)
        bad = row[:]
        how = rng.choice(("blank", "hyphen", "line", "merge", "both"))
        if how == "merge":
            bad[k : k + 2] = [bad[k] + bad[k + 1]]
        else:
            bad[k] = row[k][:cut] + {"blank": " ", "hyphen": "-\n", "line": "\n", "both": " "}[how] + row[k][cut:]
            if how == "both":
                bad[k] = bad[k].replace("m", "rn").replace("o", "0")
        got = " ".join(" ".join(scans.read_body(" ".join(bad).split("\n"), decoder)[0]).split())
        good += got == " ".join(row)
        total += 1
    assert good >= 0.95 * total


def test_lines_run_wherever_they_stand_and_whatever_they_end_in():
    head = [f"Head {k} of the house" for k in range(9)]
    pages = ["\n".join([*head, f"body {w} text.", "all copies numbered"]) for w in ("one", "two")]
    keys = scans.page_keys(pages[0]) & scans.page_keys(pages[1])
    page = scans.Page(pages[0], frozenset(keys))
    assert page.body == ["body one text."] and len(page.furniture) == 10
    assert scans.line_key("which ends a sentence.") == scans.line_key("and parted by hyph-") == ""


def test_tokens_equal_the_public_encoder(spark):
    import public_tokenizers as P
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    texts = ["Hello  world\n\n", "", None, "<|endoftext|> naïve 😀 żółw\t\x00", "Поезд " * 3000, " ", "a" * 5000, "don't WE'LL 12345"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("ids", F.lit(1))
    got = {r["doc_id"]: r["ids"] for r in tokens.encode(df).collect()}
    assert got == {k: (t.encode(x, add_special_tokens=False).ids if x else []) for k, x in enumerate(texts)}
    codec = tokens.Codec(tokens.serialise(tokens.read_ranks(tokens.vocabulary_path())), tokens.pattern())
    assert all(codec.decode(got[k]) == (x or "") for k, x in enumerate(texts))
    assert tokens.encode(df.where("false")).count() == 0


def test_mixture_reaches_shares_within_repeats(spark):
    rng = random.Random(3)
    rows = [(k, s, " ".join(rng.choice(["kettle", "garden", "of", "the"]) for _ in range(rng.randrange(5, 200)))) for k, s in enumerate(["big"] * 1500 + ["small"] * 150 + ["other"] * 80)]
    rows += [(9001, None, "x"), (9002, "big", None), (9003, "big", ""), (9004, "unknown", "text"), (0, "big", rows[0][2])]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string").withColumn("copies", F.lit("clash"))
    targets = spark.createDataFrame([("big", 0.5, 1), ("small", 0.4, 4), ("none", 0.1, 3)], "source string, target_share double, max_repeats int")
    chosen, shares = mixing.mix(docs, targets)
    got = {r["source"]: r for r in shares.collect()}
    assert abs(got["big"]["actual_share"] - 5 / 9) < 0.02 and abs(got["small"]["actual_share"] - 4 / 9) < 0.02 and got["none"]["actual_share"] == 0
    most = {r["source"]: r["m"] for r in chosen.groupBy("source").agg(F.max("copies").alias("m")).collect()}
    assert most["big"] == 1 and most["small"] == 4 and set(most) == {"big", "small"}
    assert chosen.count() == chosen.select("doc_id").distinct().count()
    c, s = mixing.mix(docs.where("false"), targets)
    assert c.count() == 0 and {r["actual_share"] for r in s.collect()} == {0.0}


KINDS = [
    ("prose", "First the kettle opened a quiet drawer, then Marholm folded the schedule.\nNobody at the station knew what was in it, and we left before the rain came.\nOn the way home she read the letter to her brother and laughed."),
    ("list", "# Shop\n" + "\n".join(f"- quiet {w}" for w in ("lamp", "tent", "oven", "pier", "map"))),
    ("table", "Name;Size;Price\n" + "\n".join(f"lamp;{k};USD 5.{k}" for k in range(6))),
    ("table", "\n".join(f"{w}: {k}" for k, w in enumerate(("Lamp", "Tent", "Oven", "Pier")))),
    ("junk", "puzzle " * 60),
    ("junk", LONG * 4),  # the published rules for repetition count the same sentence over and over as junk
    ("junk", "~ _~,,|l;`|lIi| ~I' ,'-~i\n. ~`i;-| il`:~|. l\n"),
    ("junk", "XlFm898Fyo7vS12qZzDVd3APpHPKFl8WQrtiHEUlOWDLc3HtCI450kVNXG7CJ7xx"),
    (None, "  \n "),
    (None, None),
]


def test_kinds_and_reasons(spark):
    df = spark.createDataFrame([(k, t) for k, (_, t) in enumerate(KINDS)], "doc_id long, text string").withColumn("kind", F.lit(1)).withColumn("n_words", F.lit("x"))
    got = {r["doc_id"]: r for r in quality.judge(df).collect()}
    assert [got[k]["kind"] for k in range(len(KINDS))] == [w for w, _ in KINDS]
    assert got[8]["reasons"] == ["blank"] and "repeated_pairs" in got[4]["reasons"] and got[0]["n_words"] == 41 and got[0]["reasons"] == ["too_few_words"]
    assert "bullets" in got[1]["reasons"] and "short_lines" in got[1]["reasons"] and "mean_word_length" in got[7]["reasons"]
    assert quality.judge(df.where("false")).count() == 0


def brute_figures(text):
    """The figures that can be said in a few plain lines."""
    lines = [x.strip() for x in text.split("\n") if x.strip()]
    words = text.split()
    bare = [w.lower().strip(quality.EDGE) for w in words if any(c.isalnum() for c in w)]
    size = sum(map(len, words))

    def top(k):
        runs = [tuple(bare[i : i + k]) for i in range(len(bare) - k + 1)]
        real = [w for w in words if any(c.isalnum() for c in w)]
        return max((sum(len(real[runs.index(r) + j]) for j in range(k)) * runs.count(r) for r in set(runs) if runs.count(r) > 1), default=0) / size

    return {
        "n_words": len(words), "n_lines": len(lines), "repeated_lines": 1 - len(set(lines)) / len(lines), "short_lines": sum(len(x) <= 30 for x in lines) / len(lines),
        "digit_ratio": sum(c.isdigit() for c in text) / size, "top_2": top(2), "top_3": top(3), "top_4": top(4), "n_common": sum(w in quality.COMMON for w in bare),
    }


@pytest.mark.parametrize("seed", range(5))
def test_figures_equal_brute_force(seed):
    import pyarrow as pa

    rng = random.Random(seed)
    texts = ["".join(rng.choice(["kettle", "the", "and", "lamp", "12", "x.", "Ünder", "-"]) + rng.choice([" ", " ", "\n", "\n\n"]) for _ in range(rng.randrange(1, 120))) for _ in range(20)]
    got = quality.judge_batch(pa.array(texts, pa.large_string()))
    for k, t in enumerate(texts):
        for name, want in brute_figures(t).items():
            assert got[name][k] == pytest.approx(want), (name, t)


def test_kinds_against_hand_labels(spark):
    """The rules' thresholds are published ones; the forms of lines were settled while looking at the labels."""
    d = "/root/testdata/sf0.01"
    judged = quality.judge(spark.read.parquet(f"{d}/documents.parquet")).select("doc_id", F.col("kind").alias("got"))
    rows = judged.join(spark.read.parquet(f"{d}/doc_labels.parquet"), "doc_id").collect()
    assert sum(r["got"] == r["kind"] for r in rows) >= 0.95 * len(rows)
