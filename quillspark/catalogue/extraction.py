"""Metadata, entities, document types, summaries, whole texts of the library."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..constants import CURRENCY_CODES, DOCUMENT_TYPES, ENTITY_CONFIDENCE, PATTERNS
from ..functions.text import entity_key, merge_lines, normalise_tag, query_key
from ..operators import metadata as M
from .common import chunks, table

Q: dict = {}
O: dict = {}  # noqa: E741


def query(sql: str | None = None):
    def add(f):
        Q[f.__name__] = f
        if sql:
            O[f.__name__] = sql
        return f

    return add


def _re(name: str) -> str:
    return PATTERNS[name].replace("'", "''")


def _all(name: str, group: int = 0, col: str = "text") -> str:
    return f"regexp_extract_all({col}, '{_re(name)}', {group})"


def _sd(x: str, most: int | None = None) -> str:
    out = f"list_sort(list_distinct({x}))"
    return f"{out}[1:{most}]" if most else out


TEXTS = "t AS (SELECT DISTINCT id, text FROM chunks WHERE text IS NOT NULL)"


def _texts(spark, d):
    return chunks(spark, d).where("text is not null").select("id", "text")


@query(f"WITH {TEXTS} SELECT * FROM (SELECT id, {_sd(_all('email'))} AS emails FROM t) WHERE len(emails) > 0")
def email_extract(spark, d):
    return _texts(spark, d).select("id", M.emails(F.col("text"), unicode=False).alias("emails")).where(F.size("emails") > 0)


@query(
    f"WITH {TEXTS}, u AS (SELECT id, {_sd('list_filter(list_transform(' + _all('url') + chr(44) + ' lambda x: rtrim(x, ' + repr('.,') + ')), lambda x: NOT contains(x, ' + repr('@') + '))')} AS urls FROM t) SELECT * FROM u WHERE len(urls) > 0"
)
def url_extract(spark, d):
    return _texts(spark, d).select("id", M.urls(F.col("text"), unicode=False).alias("urls")).where(F.size("urls") > 0)


@query(f"WITH {TEXTS}, p AS (SELECT id, {_sd('list_filter(list_transform(' + _all('phone') + ', lambda x: trim(regexp_replace(x, ' + repr(chr(92) + 's+$') + ', ' + repr('') + '))), lambda x: length(regexp_replace(x, ' + repr('[^0-9]') + ', ' + repr('') + ', ' + repr('g') + ')) >= 7)')} AS phones FROM t) SELECT * FROM p WHERE len(phones) > 0")
def phone_extract(spark, d):
    return _texts(spark, d).select("id", M.phones(F.col("text")).alias("phones")).where(F.size("phones") > 0)


@query(f"WITH {TEXTS} SELECT * FROM (SELECT id, {_sd(_all('identifier'), 30)} AS identifiers FROM t) WHERE len(identifiers) > 0")
def identifier_extract(spark, d):
    return _texts(spark, d).select("id", M.identifiers(F.col("text"), unicode=False).alias("identifiers")).where(F.size("identifiers") > 0)


@query(f"WITH {TEXTS} SELECT id, {_sd(_all('date_iso') + ' || ' + _all('date_number') + ' || ' + _all('date_text'), 20)} AS dates, {_sd(_all('time'), 20)} AS times FROM t")
def date_time_extract(spark, d):
    return _texts(spark, d).select("id", M.dates(F.col("text"), False).alias("dates"), M.times(F.col("text"), False).alias("times"))


_CUR = "CASE lower(s) " + " ".join(f"WHEN '{w}' THEN '{c}'" for w, c in CURRENCY_CODES.items()) + " END"


@query(
    f"""WITH {TEXTS}, r AS (SELECT id, list_transform({_all('amount')}, lambda x: trim(x)) AS raws FROM t),
    o AS (SELECT id, (list_filter(list_transform(raws, lambda x, i: CASE WHEN i = 1 OR raws[i - 1] <> x THEN x END), lambda x: x IS NOT NULL))[1:20] AS raws FROM r),
    u AS (SELECT id, i, raws[i] AS raw FROM (SELECT id, raws, unnest(range(1, len(raws) + 1)) AS i FROM o))
    SELECT id, i::INT AS position, raw, try_cast(replace(regexp_extract(raw, '(\\d[\\d,]*(?:\\.\\d+)?)', 1), ',', '') AS DOUBLE) AS value,
    (SELECT {_CUR} FROM (SELECT trim(regexp_replace(raw, '[\\d,\\s]+(?:\\.\\d+)?', '', 'g')) AS s)) AS currency FROM u"""
)
def amount_extract(spark, d):
    return _texts(spark, d).select("id", F.posexplode(M.amounts(F.col("text"))).alias("p", "a")).select("id", (F.col("p") + 1).alias("position"), "a.*")


@query(f"WITH {TEXTS} SELECT id, {_sd(_all('hashtag'))} AS hashtags, {_sd(_all('mention', 1))} AS mentions, {_sd(_all('location', 1), 10)} AS locations FROM t")
def tag_mention_location_extract(spark, d):
    t = F.col("text")
    return _texts(spark, d).select("id", M.hashtags(t).alias("hashtags"), M.mentions(t).alias("mentions"), M.locations(t, False).alias("locations"))


_KINDS = ("pnr", "train_number", "flight_number", "booking_id", "invoice_id")
_SPACE = r"[ \t\n\x0B\f\r]+"
_ENT = " UNION ALL ".join(f"SELECT id, '{k}' AS entity_type, unnest({_all(k, 1)}) AS raw, {ENTITY_CONFIDENCE[k]}::DOUBLE AS confidence FROM t" for k in _KINDS)


@query(f"WITH {TEXTS}, e AS ({_ENT}) SELECT id, entity_type, upper(regexp_replace(raw, '{_SPACE}', '', 'g')) AS normalized_value, max(confidence) AS confidence, count(*) AS times FROM e GROUP BY ALL")
def code_entities(spark, d):
    """Typed codes of every text with how often they occur; ``entity_extract`` adds dates, amounts, routes and the cap."""
    from ..functions.patterns import all_matches

    t = F.col("text")
    typed = lambda k: F.transform(all_matches(t, k, 1, False), lambda v: F.struct(F.lit(k).alias("entity_type"), v.alias("raw")))
    lists = F.flatten(F.array(*[typed(k) for k in _KINDS]))
    table_ = F.create_map(*[F.lit(x) for kv in ENTITY_CONFIDENCE.items() for x in kv])
    rows = _texts(spark, d).select("id", F.explode(lists).alias("e")).select("id", "e.entity_type", entity_key(F.col("e.raw")).alias("normalized_value"))
    return rows.groupBy("id", "entity_type", "normalized_value").agg(F.count("*").alias("times")).withColumn("confidence", F.element_at(table_, F.col("entity_type")))


@query()
def entity_extract(spark, d):
    m = M.extract(_texts(spark, d).withColumn("filename", F.lit("")), unicode=False)
    return M.entities(m, "id", unicode=False)


def _types_sql(h: str, t: str) -> str:
    fires = []
    for name, score, cues in DOCUMENT_TYPES:
        cond = " OR ".join(f"contains({h}, '{c}')" for c in cues)
        if name == "train_ticket":
            cond += f" OR regexp_matches({t}, '{_re('pnr')}')"
        if name == "flight_ticket":
            cond += f" OR regexp_matches({t}, '{_re('flight_number')}')"
        fires.append((name, score, cond, f"list_filter({list(cues)}, lambda c: contains({h}, c))"))
    pick = lambda k: " ".join(f"WHEN {f[2]} THEN {f[k] if k else repr(f[0])}" for f in fires)
    return f"CASE {pick(0)} ELSE 'other' END AS document_type, CASE {pick(1)} ELSE 0 END::DOUBLE AS confidence, CASE {pick(3)} ELSE [] END AS evidence"


@query(f"WITH {TEXTS}, h AS (SELECT id, text, lower(chr(10) || text || chr(10)) AS h FROM t) SELECT id, {_types_sql('h', 'text')} FROM h")
def document_classify(spark, d):
    return M.classify(_texts(spark, d).withColumn("filename", F.lit("")), unicode=False).select("id", "document_type", "confidence", "evidence")


_DOCS = (
    (1, "ticket.txt", "PNR: ABCDE12345 train no 12951 from Delhi to Mumbai\nFare Rs. 1,250.50 on 2024-05-06 at 10:30 pm"),
    (2, "bill.pdf", "Tax invoice INV-93472 bill to A. Person, total $45.00, see www.example.com. Mail a@example.com, @someone #paid"),
    (3, "note.md", "nothing to see here"),
    (4, "stay.txt", "Hotel check-in 3 May 2024, booking id: HX-99812, phone +44 20 7946 0958"),
)


@query("SELECT * FROM (VALUES (1, 'train_ticket', 'Filename: ticket.txt. Detected dates: 2024-05-06. Detected amounts: Rs. 1,250.50. Identifiers: 12951, ABCDE12345. OCR content: " + _DOCS[0][2].replace("\n", "' || chr(10) || '") + " Document type: train ticket.')) AS v(id, document_type, summary)")
def structured_summary(spark, d):
    rows = spark.createDataFrame([r for r in _DOCS if r[0] == 1], "id int, filename string, text string")
    m = M.classify(M.extract(rows))
    none = F.array().cast("array<string>")
    return m.select("id", "document_type", M.summary(F.col("filename"), none, F.col("dates"), F.col("amounts"), F.col("urls"), F.col("identifiers"), F.col("text"), F.col("document_type")).alias("summary"))


_KEYS = (("RCL-4821", "RCL-4821", "RCL4821"), ("a b c", "ABC", "ABC"), ("x1", "X1", None), ("Köln 50", "KÖLN50", "KÖLN50"))


@query("SELECT * FROM (VALUES " + ", ".join(f"('{r}', '{s}', {repr(q) if q else 'NULL'})" for r, s, q in _KEYS) + ") AS v(raw, stored, asked)")
def entity_keys(spark, d):
    rows = spark.createDataFrame([(r,) for r, _, _ in _KEYS], "raw string")
    return rows.select("raw", entity_key(F.col("raw")).alias("stored"), query_key(F.col("raw")).alias("asked"))


@query(r"SELECT DISTINCT t.label, translate(trim(regexp_replace(t.label, '[^\p{L}\p{N}]+', ' ', 'g')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS tag FROM (SELECT p_name AS label FROM part UNION ALL SELECT p_type FROM part) t")
def tag_normalise(spark, d):
    p = table(spark, d, "part")
    return p.select(F.explode(F.array("p_name", "p_type")).alias("label")).distinct().select("label", normalise_tag(F.col("label")).alias("tag"))


@query("SELECT * FROM (VALUES (1, 'Total 5' || chr(10) || 'Thank you' || chr(10) || 'Extra'), (2, 'abc')) AS v(id, merged)")
def merge_readings(spark, d):
    rows = spark.createDataFrame([(1, "Total 5\nThank you\n--", "TOTAL: 5\nExtra\nthank you!"), (2, "abc", "a-b c")], "id int, a string, b string")
    return rows.select("id", merge_lines(F.col("a"), F.col("b")).alias("merged"))


QUERIES, ORACLE = Q, O
