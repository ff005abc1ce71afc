"""Repair of text from scanned pages: running lines, page numbers, words broken at line ends, misread characters.

  1. Lexicon: words are counted over the whole corpus of texts read from files; the most frequent ``lexicon_size`` of
     those seen ``least`` times and more are the model of what a word is.
  2. Running lines: every line of a page gets a key in which numbers are one sign and characters that
     are mistaken for each other are one character; a key that stands on two and more pages of an asset runs, if nothing
     but running lines and page numbers stands between it and the page's edge.
  3. Decoding: what remains of a page is one character stream. Around every place that is not plain known words the
     stream is decoded anew, line ends, blanks and hyphens included, by one lattice: its edges are lexicon words that the
     characters can stand for under confusions (rn/m, cl/d, 0/o, ...), across blanks, line ends and hyphens that may have
     been put in, ends of words where a blank is missing, and, at a higher cost, what stands there. The path of the
     least cost by word frequency, confusions, splits and merges wins (Viterbi); faults are read from it.
  4. Paragraphs: line ends become spaces or paragraph ends by dynamic programming over the lines, with costs for short
     lines, sentence ends, blank lines and indents.

Defined results: a text is of a scanned page if its source begins with ``ocr`` in any letter case; null and empty texts
have no faults; null page numbers are pages of their own; repeated rows count once; pages of any length are read
whole; an empty table gives no rows, an empty lexicon corrects nothing; other columns are ignored.

Scale: running keys are found with a map-side minimum and maximum, so an asset with a third of all pages is no hot
group; what is broadcast is the lexicon, bounded by its size.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WORD = re.compile(r"[^\W\d_]+(?:[-'’][^\W\d_]+)*")
#: fixed values: what a character looks like; characters with equal pictures are confused with each other
PICTURES = {
    "0": "o", "1": "l", "i": "l", "!": "l", "|": "l", "j": "j", "5": "s", "$": "s", "@": "a", "4": "a", "9": "g", "q": "g", "6": "b", "8": "b", "3": "e", "c": "e",
    "7": "t", "2": "z", "n": "rl", "h": "ll", "u": "ll", "d": "el", "w": "vv", "ﬁ": "fl", "ﬂ": "fl", "í": "l", "ì": "l", "€": "e", "£": "e", "¢": "e", "©": "e",
}
PICTURES["m"] = "r" + PICTURES["n"]
HYPHENS = "-\xad¬‐"
PICTURE = {ord(k): v for k, v in PICTURES.items()}


def picture(word: str) -> str:
    return word.lower().translate(PICTURE)


NUMBER_LINE = re.compile(
    r"^[\s\-–—_.*~|=\[(<{]*(?:(?:page|pag|página|pagina|seite|strona|str|стр|с|sheet|folio|p|pg|s|blatt)[.:]?\s*)?(?:[0-9lIiOoSBZ|!]{1,5}|[ivxlcIVXLC]{1,7})(?:\s*(?:/|of|von|de|z|из|sur)\s*[0-9lIiOoSBZ|!]{1,5})?[\s\-–—_.*~|=\])>}]*$",
    re.I,
)


def is_page_number(line: str) -> bool:
    s = line.strip()
    if s.endswith(".") or not NUMBER_LINE.match(s):  # with a full stop it is a sentence's end, as a year
        return False
    bare = re.sub(r"(?i)page|pag|página|pagina|seite|strona|sheet|folio|blatt|of|von|sur", "", s)
    return bool(re.search(r"[0-9]", bare) or re.search(r"^[^\w]*[ivxlIO|!]+[^\w]*$", bare.strip(), re.I))


def line_key(line: str) -> str:
    """Equal for lines that differ by numbers, spacing, case and misread characters; empty for lines that cannot run:
    those that end like a sentence or inside a word, or say too little."""
    if re.search(rf"[{HYPHENS}.,;!?]$", line.strip()) and not re.search(r"\w[!|]$", line.strip()):
        return ""
    words = [picture(w) for w in line.split() if not re.fullmatch(r"[0-9lIOoSB|!]*[0-9][0-9lIOoSB|!.,/]*", w)]
    return " ".join(words) if sum(map(len, words)) > 3 else ""


def key_hash(key: str) -> int:
    import xxhash

    return xxhash.xxh3_64_intdigest(key) - (1 << 63)


def page_keys(text: str) -> set[int]:
    return {key_hash(k) for x in text.splitlines() if x.strip() and not is_page_number(x) and (k := line_key(x))}


class Page:
    """A page parted into furniture (lines before and behind the body) and body lines."""

    def __init__(self, text: str, running: set[int] | frozenset[int]):
        self.lines = text.splitlines()
        n = len(self.lines)
        kind = [""] * n
        for order in (range(n), range(n - 1, -1, -1)):
            for k in order:
                s = self.lines[k].strip()
                if not s:
                    continue
                if is_page_number(s):
                    kind[k] = "page_number"
                elif running and (key := line_key(s)) and key_hash(key) in running:
                    kind[k] = "running_line"
                else:
                    break
        self.kind = kind
        self.furniture = list(dict.fromkeys((k, s.strip()) for k, s in zip(kind, self.lines) if k))
        self.body = [s for k, s in zip(kind, self.lines) if not k]


TOKEN = re.compile(r"[^\s,;:?()\"“”„…«»—–/]+")
STRIP = ".,;:?()[]{}\"'“”‘’„…«»*_—–"


def _core(token: str) -> tuple[int, int]:
    """The part of a token without adjoining punctuation; marks that can be misread letters stay inside."""
    a, b = 0, len(token)
    while a < b and token[a] in STRIP:
        a += 1
    while b > a and token[b - 1] in STRIP:
        b -= 1
    return a, b


def _is_word(core: str) -> bool:
    letters = sum(c.isalpha() for c in core)
    digits = sum(c.isdigit() for c in core)
    return len(core) >= 3 and letters >= 2 and digits <= 2 and letters > digits and not re.match(r"^[A-Z]{2,}[-\d]", core)


def _like(raw: str, word: str) -> str:
    """``word`` with the capitals of what stands there."""
    if raw.lower() == word:
        return raw
    first = next((c for c in raw if c.isalpha()), "a")
    if first.isupper() and raw[0] == first:
        return word.upper() if raw.isupper() and len(raw) > 3 else word[0].upper() + word[1:]
    return word


#: costs in natural logarithms beside those of words: what stands there stays, by token and character; a changed
#: character; a blank put in; a blank left out; a line end without hyphen put in; a hyphen's two readings at a line end
STAYS, STAYS_CHAR, CHANGED, BLANK_IN, BLANK_OUT, LINE_IN, HYPHEN_GOES, HYPHEN_STAYS = 20.0, 1.0, 3.0, 9.0, 9.0, 7.0, 0.5, 2.0
DEEP = 6  # beginnings of pictures up to this length are known


class Decoder:
    """Viterbi decoding of a page's character stream over a lexicon."""

    def __init__(self, lexicon: dict[str, int]):
        self.count = lexicon
        self.total = math.log(sum(lexicon.values()) + 1.0)
        self.by: dict[str, list[str]] = {}
        self.begins: set[str] = set()
        self.longest = 1
        for w in lexicon:
            shape = picture(w)
            self.by.setdefault(shape, []).append(w)
            self.begins.update(shape[:k] for k in range(1, min(DEEP, len(shape)) + 1))
            self.longest = max(self.longest, len(shape))

    def cost(self, word: str) -> float:
        return self.total - math.log(self.count[word])

    @staticmethod
    def changes(raw: str, word: str) -> int:
        """Confusions between what stands there and a word of the same picture: differing characters after common ends."""
        a, b = raw.lower(), word
        x = 0
        while x < min(len(a), len(b)) and a[x] == b[x]:
            x += 1
        y = 0
        while y < min(len(a), len(b)) - x and a[-1 - y] == b[-1 - y]:
            y += 1
        return max(len(a), len(b)) - x - y

    def best_word(self, raw: str, shape: str) -> tuple[float, str] | None:
        """The cheapest lexicon word that the characters can stand for; short ones only as they are."""
        low = raw.lower()
        if low in self.count:
            return self.cost(low), low
        if len(low) < 3:
            return None
        return min(((self.cost(w) + CHANGED * self.changes(low, w), w) for w in self.by.get(shape, ()) if len(w) > 2), default=None)

    def known(self, core: str) -> bool:
        low = core.lower()
        return low in self.count or low[-1] == "!" and low[:-1] in self.count

    def edges(self, text: str, a: int, ends: set[int], inner: bool):
        """(cost, b, raw, word, parted) of the lexicon words that text[a:b] can stand for.

        ``ends``: where tokens end; elsewhere a word may end only if ``inner``, at the cost of a missing blank."""
        stack = [(a, "", "", 0.0, "")]
        while stack:
            k, raw, shape, cost, parted = stack.pop()
            if raw and (k in ends or inner and len(raw) > 2) and (found := self.best_word(raw, shape)):
                yield cost + found[0] + (0.0 if k in ends else BLANK_OUT), k, raw, found[1], parted
            if k >= len(text) or len(shape) > self.longest:
                continue
            c = text[k]
            if c in HYPHENS and (m := LINE_END.match(text, k + 1)):
                if raw and not parted and m.end() < len(text):
                    for sign, more in (("", HYPHEN_GOES), ("-", HYPHEN_STAYS)):
                        if self._begins(shape + sign):
                            stack.append((m.end(), raw + sign, shape + sign, cost + more, c))
                if c != "-":
                    continue
            if c in " \t\n":
                m = BLANKS.match(text, k)
                line = "\n" in m[0]
                if raw and not (line and parted) and m.end() < len(text) and cost < STAYS:
                    stack.append((m.end(), raw, shape, cost + (LINE_IN if line else BLANK_IN), "\n" if line else parted))
                continue
            now = shape + picture(c)
            if self._begins(now):
                stack.append((k + 1, raw + c, now, cost, parted))

    def _begins(self, shape: str) -> bool:
        return shape[:DEEP] in self.begins

    def _as_it_stands(self, text: str, a: int, b: int, tokens: list[tuple[int, int]], t: int):
        """Edges that need no lexicon word: the token itself, and the token with the next one where a hyphen parts them."""
        raw = text[a:b]
        yield STAYS + STAYS_CHAR * len(raw) if _is_word(raw) else 1.0, b, raw, raw.lower(), ""
        if (k := raw.find("-", 1)) > 0 and k + 1 < len(raw):  # a part of it, at half the cost
            yield STAYS / 2 + STAYS_CHAR * k, a + k, raw[:k], raw[:k].lower(), ""
        if raw[-1] in HYPHENS and len(raw) > 1 and t + 1 < len(tokens) and "\n" in text[b : tokens[t + 1][0]] and not text[b : tokens[t + 1][0]].strip():
            x, y = tokens[t + 1]
            left, right = raw[:-1], text[x:y]
            if not (right[0].isalpha() and _is_word(left + right)):
                return
            yield STAYS + STAYS_CHAR * len(left + right) + 1.0, y, left + right, (left + right).lower(), raw[-1]
            if raw[-1] == "-" and len(left) > 2 and len(right) > 2 and left.lower() in self.count and right.lower() in self.count:
                yield self.cost(left.lower()) + self.cost(right.lower()) + HYPHEN_STAYS, y, f"{left}-{right}", f"{left}-{right}".lower(), "-"

    def decode(self, text: str, tokens: list[tuple[int, int]]) -> list[tuple[int, int, str, str, str]]:
        """The cheapest path over ``text``: (begin, end, raw, word, parted) of its words. ``tokens``: spans of what stands there."""
        starts = {a: t for t, (a, _) in enumerate(tokens)}
        ends = {b for _, b in tokens} | {b - 1 for a, b in tokens if b - a > 2 and text[b - 1] == "!"}
        inside = set()  # where a word may begin although no blank stands before it
        for a, b in tokens:
            if b - a >= 6 and not self.known(text[a:b]) and text[a:b].islower() and text[a:b].replace("!", "").replace("|", "").isalnum():
                inside.update(range(a + 3, b - 2))
            inside.update(k + 1 for k in range(a + 1, b - 1) if text[k] == "-")
        ends |= {k - 1 for k in inside if text[k - 1] == "-"}
        best: dict[int, tuple[float, int, tuple | None]] = {0: (0.0, 0, None)}

        def reach(a: int, b: int, cost: float, word: tuple | None):
            if b not in best or cost < best[b][0]:
                best[b] = cost, a, word

        for a in range(len(text)):
            if a not in best:
                continue
            base = best[a][0]
            if a in starts or a in inside:
                t = starts.get(a)
                missing = t is None and text[a - 1] != "-"
                token_end = next(b for x, b in tokens if x <= a < b)
                inner = token_end in inside or any(k in inside for k in range(a + 3, token_end - 2))
                for cost, b, raw, word, parted in self.edges(text, a, ends, inner):
                    if b in ends or b in inside:
                        reach(a, b, base + cost, (a, b, raw, word, parted))
                if t is not None:
                    for cost, b, raw, word, parted in self._as_it_stands(text, a, tokens[t][1], tokens, t):
                        reach(a, b, base + cost, (a, b, raw, word, parted))
                elif not missing:
                    to = text.find("-", a + 1, token_end - 1)
                    raw = text[a : to if to > 0 else token_end]
                    reach(a, a + len(raw), base + STAYS / 2 + STAYS_CHAR * len(raw), (a, a + len(raw), raw, raw.lower(), ""))
            if a in ends or a == 0 and a not in starts:
                b = a
                while b < len(text) and b not in starts and b not in inside:
                    b += 1
                if b > a or b == len(text):
                    reach(a, b, base + 0.1, None)
        path, at = [], len(text)
        while at > 0:
            _, before, word = best[at]
            if word:
                path.append(word)
            at = before
        path.reverse()
        whole = []  # words that a hyphen joins are one
        for w in path:
            if whole and w[0] == whole[-1][1] + 1 and text[whole[-1][1]] == "-" and text[w[0] : w[0] + 1].strip():
                x = whole.pop()
                w = (x[0], w[1], f"{x[2]}-{w[2]}", f"{x[3]}-{w[3]}", x[4] or w[4])
            whole.append(w)
        return whole


LINE_END = re.compile(r"[ \t]*\n\s*")
BLANKS = re.compile(r"\s+")


def stretches(text: str, decoder: Decoder) -> list[list[tuple[int, int]]]:
    """Where the stream must be decoded: runs of tokens (spans without adjoining punctuation) that hold an unknown one or one
    that ends in a line's hyphen, with a neighbour on either side where only blanks stand between."""
    spans = []
    for m in TOKEN.finditer(text):
        a, b = _core(m[0])
        if a < b:
            spans.append((m.start() + a, m.start() + b))
    odd = [False] * len(spans)
    for k, (a, b) in enumerate(spans):
        core = text[a:b]
        odd[k] = not decoder.known(core) and (_is_word(core) or core[-1] in HYPHENS and len(core) > 1)
    take = list(odd)
    near = lambda k: not text[spans[k][1] : spans[k + 1][0]].strip()
    for k in range(len(spans) - 1):
        if near(k):
            if odd[k]:
                take[k + 1] = True
            if odd[k + 1]:
                take[k] = True
    out: list[list[tuple[int, int]]] = []
    for k, span in enumerate(spans):
        if take[k]:
            if out and k and take[k - 1] and near(k - 1):
                out[-1].append(span)
            else:
                out.append([span])
    return out


def read_body(body: list[str], decoder: Decoder):
    """Repaired lines, broken words, misread words; a line end inside a word is gone, the others stay."""
    text = "\n".join(x.rstrip() for x in body)
    broken, misread, out, last, before = [], [], [], 0, -1
    for spans in stretches(text, decoder):
        a, b = spans[0][0], spans[-1][1]
        for x, y, raw, word, parted in decoder.decode(text[a:b], [(p - a, q - a) for p, q in spans]):
            shown = _like(raw, word)
            if parted:
                broken.append(shown)
            elif raw.lower() != word:
                misread.append(shown)
            if a + x == before:  # a blank was missing
                out += [text[last : a + x], " "]
                last = a + x
            if shown != text[a + x : a + y]:
                out += [text[last : a + x], shown]
                last = a + y
            before = a + y
    out.append(text[last:])
    return "".join(out).split("\n"), list(dict.fromkeys(broken)), list(dict.fromkeys(misread))


def paragraphs(lines: list[str]) -> str:
    """Line ends become spaces or paragraph ends: the cheapest labelling of all line ends."""
    lines = [x.rstrip() for x in lines]
    real = [k for k, x in enumerate(lines) if x.strip()]
    if not real:
        return ""
    width = sorted(len(lines[k]) for k in real)[int(0.8 * (len(real) - 1))] or 1
    # two states at each line end: 0 goes on, 1 ends a paragraph; a paragraph of one line costs extra
    cost, back = [0.0, 0.5], []
    for p, q in zip(real[:-1], real[1:]):
        end, nxt = lines[p].rstrip(), lines[q]
        go = 0.0
        go += 4.0 if q - p > 1 else 0.0
        go += 2.0 if len(end) < 0.6 * width and re.search(r"[.!?…:][\"'”)]*$", end) else 0.0
        go += 1.5 if re.match(r"\s*(?:[-*•]|\d+[.)])\s", nxt) else 0.0
        go += 0.5 if len(nxt) - len(nxt.lstrip()) > len(lines[p]) - len(lines[p].lstrip()) + 1 else 0.0
        stop = 1.0 + (2.0 if re.match(r"\s*[a-zà-ÿ]", nxt) else 0.0) + (1.0 if not re.search(r"[.!?…:][\"'”)]*$", end) else 0.0)
        new = [min((cost[s] + go, s) for s in (0, 1)), min((cost[s] + stop + (0.5 if s else 0.0), s) for s in (0, 1))]
        back.append([new[0][1], new[1][1]])
        cost = [new[0][0], new[1][0]]
    state = 0 if cost[0] <= cost[1] else 1
    labels = []
    for step in reversed(back):
        labels.append(state)
        state = step[state]
    labels.reverse()
    out = [lines[real[0]].strip()]
    for label, k in zip(labels, real[1:]):
        out.append(("\n\n" if label else " ") + lines[k].strip())
    return re.sub(r"[ \t]{2,}", " ", "".join(out))


def is_scan(col: str = "source"):
    return F.lower(F.col(col)).startswith("ocr")


def count_words(texts: DataFrame, least: int = 3, lexicon_size: int = 200_000) -> DataFrame:
    """(word, n) over all texts (one column)."""

    def run(batches):
        n = Counter()
        for batch in batches:
            for t in batch.column(0).to_pylist():
                n.update(WORD.findall(t.lower()))
            if len(n) > 1_000_000:
                yield pa.RecordBatch.from_pydict({"word": pa.array(list(n), pa.string()), "n": pa.array(list(n.values()), pa.int64())})
                n.clear()
        yield pa.RecordBatch.from_pydict({"word": pa.array(list(n), pa.string()), "n": pa.array(list(n.values()), pa.int64())})

    return texts.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least).orderBy(F.desc("n"), "word").limit(lexicon_size)


def _pages(chunks: DataFrame) -> DataFrame:
    return chunks.where(is_scan()).select("id", "asset_id", "text").where("id is not null and text is not null and length(text) > 0")


def running_keys(pages: DataFrame) -> DataFrame:
    """(id, keys): hashes of the running lines' keys of each page that has any."""

    def run(batches):
        for batch in batches:
            rows = [(i, a, k) for i, a, t in zip(*[batch.column(c).to_pylist() for c in range(3)]) if a is not None for k in page_keys(t)]
            yield pa.RecordBatch.from_pydict({n: pa.array([r[c] for r in rows], t) for c, (n, t) in enumerate((("id", pa.string()), ("asset_id", pa.string()), ("key", pa.int64())))})

    keys = pages.mapInArrow(run, "id string, asset_id string, key long")
    runs = keys.groupBy("asset_id", "key").agg(F.min("id").alias("a"), F.max("id").alias("b")).where("a <> b").select("asset_id", "key")
    return keys.join(runs, ["asset_id", "key"]).groupBy("id").agg(F.collect_set("key").alias("keys"))


def _read(chunks: DataFrame, run, schema: str, least: int, lexicon_size: int) -> DataFrame:
    spark = chunks.sparkSession
    plain = chunks.where(F.col("source").isNull() & F.col("text").isNotNull()).select("text")
    lexicon = spark.sparkContext.broadcast({r["word"]: r["n"] for r in count_words(plain, least, lexicon_size).collect()})  # bounded by lexicon_size
    pages = _pages(chunks)
    with_keys = pages.join(running_keys(pages), "id", "left").select("id", "text", "keys")

    def go(batches):
        decoder = Decoder(lexicon.value)
        for batch in batches:
            yield run(decoder, *[batch.column(c).to_pylist() for c in range(3)])

    return with_keys.mapInArrow(go, schema)


def faults(chunks: DataFrame, least: int = 3, lexicon_size: int = 200_000) -> DataFrame:
    """(id, kind, found_value): each distinct fault of a scanned page."""

    def run(decoder, ids, texts, keys):
        rows = []
        for i, t, k in zip(ids, texts, keys):
            page = Page(t, frozenset(k or ()))
            _, broken, misread = read_body(page.body, decoder)
            rows += [(i, kind, s) for kind, s in page.furniture]
            rows += [(i, "broken_word", w) for w in broken] + [(i, "misread", w) for w in misread]
        return pa.RecordBatch.from_pydict({n: pa.array([r[c] for r in rows], pa.string()) for c, n in enumerate(("id", "kind", "found_value"))})

    return _read(chunks, run, "id string, kind string, found_value string", least, lexicon_size).distinct()


def repaired(chunks: DataFrame, least: int = 3, lexicon_size: int = 200_000) -> DataFrame:
    """(id, text): every scanned page as continuous paragraphs."""

    def run(decoder, ids, texts, keys):
        done = [paragraphs(read_body(Page(t, frozenset(k or ())).body, decoder)[0]) for t, k in zip(texts, keys)]
        return pa.RecordBatch.from_pydict({"id": pa.array(ids, pa.string()), "text": pa.array(done, pa.string())})

    return _read(chunks, run, "id string, text string", least, lexicon_size).dropDuplicates(["id"])
