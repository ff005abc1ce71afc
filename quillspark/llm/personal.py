"""Personal information in free text, found by weak supervision.

Labelers vote on candidate spans: a strict form, a loose form, cue words before and behind, name parts (common given
names, and those that stand at cues elsewhere in the corpus), words that speak against it, ordinary words written with a
capital. Nobody labels by hand, and no labeler knows the wording of a particular collection:

  1. Words: over the whole corpus it is counted how often a word stands in a name at a strong cue, and how often it is
     written in lower case, in tables of ``CELLS`` counters by hash.
  2. Votes: all candidates with their votes, contexts and forms are written to the shared folder, and the patterns of
     votes are counted, kind by kind; their number is bounded by the labelers. Expectation-maximisation on those counts
     estimates each labeler's reliability and gives every pattern its probability.
  3. Classifier: a logistic model on the votes, the words around and the span's form is fitted to these probabilities
     on at most ``sample`` candidates, chosen by hash. It decides on all candidates.

Of overlapping spans the more probable, then the longer one stays. Placeholders are [PERSON_NAME], [EMAIL], [PHONE],
[ID_NUMBER], [ADDRESS].

Defined results: null and empty texts have no mentions and stay as they are; texts of any length are read whole;
repeated rows and repeated mentions count once; an empty table gives no rows and an empty model, with which the votes
alone decide; other columns are ignored.

Scale: two maps over the texts; only count tables of fixed size and counts of vote patterns are shuffled, after map-side
sums, and the sample, cut to its size per pattern in every partition before its shuffle.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

KINDS = ("person_name", "email", "phone", "id_number", "address")
CAP = r"(?:(?:(?:Mc|Mac|O['’]|D['’])?[A-ZÀ-ÖØ-ÞĀ-ŽА-ЯЁ][a-zà-öø-ÿā-žа-яё]+)(?:['’-][A-ZÀ-ÖØ-ÞА-ЯЁ][a-zà-öø-ÿā-žа-яё]+)*|[A-ZÀ-ÖØ-Þ]{3,}(?:['’-][A-ZÀ-ÖØ-Þ]{2,})*)"
INITIAL = r"(?:[A-ZÀ-Þ]\.)"
PARTICLE = r"(?:van der |van den |van de |van |von der |von |de la |della |bin |ibn )"
#: fixed values: words at which names stand, directly before them (labels, titles, greetings, signatures)
NAME_BEFORE = (
    r"(?:guest(?: name)?|contact(?: person)?|passenger|attn\.?|attention|att|signed by|signed|dear|hello|hi|mrs?\.?|ms\.?|miss|dr\.?|prof\.?|professor|doctor|sir|madam|"
    r"in the name of|on behalf of|name|holder|tenant|patient|customer|client|traveller|employee|author|reviewed by|prepared by|approved by|sent by|written by|regards,?|sincerely,?|uncle|aunt|"
    r"ansprechpartner(?:in)?|herr|frau|kontakt|name des gastes|unterzeichnet|au nom de|madame|monsieur|mme|mlle|m\.|a nombre de|señora?|sra?\.|pan|pani|sr\.|dona|em nome de|господин|госпожа)"
)
#: fixed values: words that people are followed by
NAME_BEHIND = r"(?:said|says|asked|asks|told|wrote|writes|called|phoned|rang|signed|replied|answered|explained|agreed|promised|thanked|joined|lives|works|was born|and (?:his|her)|, (?:his|her|aged|born|who)|sagte|schrieb|fragte|a dit|a écrit|dijo|escribió|disse|escreveu|powiedział|napisał|сказал|написал)\b"
#: fixed values: words that begin or end no name: function words, titles, days, months, parts of addresses, kinds of places and organisations
NOT_NAME_WORD = frozenset(
    """the a an and or of for to from in on at by with her his my our your their its this that these those if when while although neither beyond under between after before
    what which can could will we i he she it they one every please dear hello hi thanks regards mrs mr ms miss dr prof professor doctor uncle aunt herr frau madame monsieur mme mlle attn attention
    contact guest passenger signed order reference seat row room gate document page no not yes but so as then also only here there now today tomorrow yesterday
    both later earlier each many some most such once perhaps maybe still again next first last finally meanwhile however somebody nobody everyone everybody either neither
    und aber auch dann später beide puis ensuite aussi et ou y o luego después también depois também e potem także и а но потом также
    street road avenue terrace close court square place drive way crescent lane box flat apartment unit suite floor building inc ltd gmbh llc plc
    le la les der die das el los las un une ein eine usd eur gbp inr rs monday tuesday wednesday thursday friday saturday sunday
    january february march april may june july august september october november december tel fax mobile telefon phone email e-mail address passport identity tax
    station hotel airport museum school university college hospital church park bridge market theatre library bank company office team club group press institute festival fair conference exhibition
    railway express line service centre center hall house shop restaurant café""".split()
)
#: fixed values: common given names
GIVEN = frozenset(
    """james john robert michael william david richard joseph thomas charles christopher daniel matthew anthony mark donald steven paul andrew joshua kenneth kevin brian george edward peter henry jack
    harry oliver noah liam lucas mary patricia jennifer linda elizabeth barbara susan jessica sarah karen lisa nancy betty margaret sandra ashley emily donna michelle carol amanda emma olivia sophia
    isabella mia charlotte grace lucy alice anna anne hans klaus jürgen wolfgang stefan andreas markus petra sabine ursula monika claudia katharina jean pierre michel jacques françois philippe marie
    nathalie isabelle sophie camille josé juan antonio manuel carlos luis miguel javier carmen maría ana lucía pedro joão paulo rui tiago inês beatriz jan piotr krzysztof andrzej tomasz paweł
    agnieszka katarzyna małgorzata magdalena ewa иван александр сергей дмитрий алексей михаил ольга елена наталья татьяна мария анна ahmed mohammed fatima ali omar wei li ravi priya arjun yuki
    kenji""".split()
)
#: fixed values: words before a number or name that speak against it
DECOY = r"(?:lot|meter|reading|version|item|parcel|order|reference|ref|isbn|room|gate|lane|hall|platform|seat|row|serial|part|model|invoice|folder|page|chapter|batch|sku|weighs|price|total|minutes)"
NAME = re.compile(rf"(?<![\w@./-])(?:{CAP}|{INITIAL})(?:,? {PARTICLE}?(?:{CAP}|{INITIAL}|[A-ZÀ-Þ](?=[ ,.;:]|$)))+(?![\w@-])")
NAME_CUE = re.compile(rf"(?:^|[^\w])(?:{NAME_BEFORE})[\s:–—-]*$", re.I)
NAME_CUE_BEHIND = re.compile(rf"^[\s,]*{NAME_BEHIND}", re.I)
EMAIL = re.compile(r"(?<![\w.+-])[A-Za-z0-9](?:[\w.+%-]*[A-Za-z0-9])? ?(?:@|\[at\]|\(at\)|\{at\}| at (?=\S+ dot )) ?[A-Za-z0-9-]+(?: ?(?:\.|\[dot\]|\(dot\)|\{dot\}| dot ) ?[A-Za-z0-9-]+)*(?:(?: ?(?:\[dot\]|\(dot\)|\{dot\}) ?)|\.| dot )[A-Za-z]{2,}", re.I)
PHONE = re.compile(r"(?<![\w.,/+-])(?:\+\d{1,3}[ .-]?|00\d{1,3}[ .-]?)?(?:\(0?\d{1,5}\)[ .-]?)?\d{2,5}(?:[ ./-]?\d{2,5}){1,5}(?![\w/-]|[.,]\d)")
ID_FORMS = (
    r"[A-Z]{2} ?\d{2} ?\d{2} ?\d{2} ?[A-Z]",
    r"\d{3}-\d{2}-\d{4}",
    r"\d{6}/\d{3,4}",
    r"[A-Z]{5}\d{4}[A-Z]",
    r"[XYZ]-?\d{7,8}-?[A-Z]?",
    r"\d{8}-?[A-Z]",
    r"[A-Z]{1,3}\d{6,9}[A-Z]?",
    r"\d{4} \d{4} \d{4}",
    r"\d{11}",
    r"\d{2,3}(?:[ .]\d{3}){2,3}(?:[-/]\d{1,2})?",
    r"[A-Z0-9]{8,12}",
)
ID = re.compile(rf"(?<![\w/+-])(?:{'|'.join(ID_FORMS)})(?![\w/-])")
ID_CUE = re.compile(r"(?:\bid|national number|identity (?:number|card|no\.?)|id(?: (?:number|no\.?|card))|passport(?: or card)?(?: (?:number|no\.?))?|card no\.?|tax (?:reference|number|id|no\.?)|social security(?: number| no\.?)?|national (?:id|insurance)(?: number| no\.?)?|nino|ssn|pan|"
                    r"ausweisnummer|ausweis(?:-nr\.?)?|steuer(?:nummer|-id|id)|personalausweis|dni|nie|nif|cpf|pesel|nip|n(?:uméro|°|º) (?:de sécurité sociale|d'identité|de passeport)|pasaporte|паспорт|снилс|инн)[\s:#–—-]*$", re.I)
ID_BEHIND = re.compile(r"^[\s,]*(?:from|on|in) (?:her|his|my|their|the) (?:identity|id|passport)", re.I)
STREET = r"(?:Street|St\.?|Road|Rd\.?|Avenue|Ave\.?|Lane|Ln\.?|Terrace|Close|Drive|Dr\.?|Court|Ct\.?|Square|Sq\.?|Place|Pl\.?|Way|Crescent|Row|Gardens|Boulevard|Blvd\.?|Parkway|Hill|Walk)"
TOWN = r"(?:[A-ZÀ-Þ][a-zà-ÿā-ž'’-]+(?: [A-ZÀ-Þ][a-zà-ÿā-ž'’-]+)?)"
POST = r"(?:\d{5}(?:-\d{4})?|[A-Z]{1,2}\d[A-Z\d]? ?\d[A-Z]{2}|\d{4,6}|\d{2}-\d{3})"
SEP = r"(?:,\s|\s|,?\n\s*)"
HEAD = r"(?:(?:Flat|Apt\.?|Apartment|Unit|Suite|Room)\s\w{1,4},?\s)?"
TAIL = rf"(?:,\s(?:Apt\.?|Apartment|Unit|Suite|Flat)\s\w{{1,4}})?(?:,\s(?:{POST}\s{TOWN}|{TOWN}(?:,?\s{POST})?)|\s{POST}\s{TOWN})?"
ADDRESS = re.compile(
    rf"(?<![\w-])(?:{HEAD}\d{{1,4}}[A-Za-z]?,?\s(?:[NSEW]\.\s)?(?:[A-ZÀ-Þ][\w'’-]+\s){{1,3}}{STREET}(?![\w]){TAIL}"
    rf"|P\.?\s?O\.?\sBox\s\d+{TAIL}"
    rf"|\d{{1,4}}(?:\s?(?:bis|ter))?,?\s(?:rue|avenue|boulevard|place|chemin|allée|impasse|quai)\s(?:(?:de|du|des|la|le|les|l'|d')\s?)*[A-ZÀ-Þ][\w'’-]+(?:\s[A-ZÀ-Þ][\w'’-]+)*{TAIL}"
    rf"|(?:[A-ZÄÖÜ][\w-]*(?:straße|strasse|str\.|weg|allee|platz|gasse|ring|damm)|[A-ZÄÖÜ]\w+\s(?:Straße|Strasse|Str\.|Weg|Allee|Platz|Gasse))\s\d{{1,4}}\s?[a-z]?{TAIL}"
    rf"|(?:[Cc]alle|[Aa]venida|[Aa]vda\.|[Pp]laza|[Pp]aseo|[Rr]ua|[Tt]ravessa|[Ll]argo|[Vv]ia|[Pp]iazza|ul\.|al\.|ул\.)\s(?:(?:de|del|da|do|dos|das|la|las|los)\s)*[A-ZÀ-ÞА-Я][\w'’-]+(?:\s[A-ZÀ-ÞА-Я][\w'’-]+)*,?\s(?:n\.?º\s?)?\d{{1,4}}\w?{TAIL})"
)
ADDRESS_CUE = re.compile(r"(?:address|deliver(?:y| it)? to|billing to|pick-?up|live[sd]? at|living at|sent to|send (?:it )?to|resid\w+ at|wohnhaft(?: in)?|adresse|anschrift|domicilio|dirección|morada|adres|habite au|located at|ship to|visit us at)[\s:–—-]*$", re.I)
PHONE_CUE = re.compile(r"(?:tel(?:efon|ephone|\.)?|phone|fax(?:/phone)?|mobile|cell|call|ring|text(?: me)?(?: on)?|numéro est le|whatsapp|teléfono|telefone|telefon(?:nummer)?|numer|handy|rufnummer|тел\.?|dial|reach (?:me|us) (?:on|at)|on)[\s:#–—.-]*$", re.I)
DECOY_BEFORE = re.compile(rf"(?:^|\W){DECOY}(?: \w+){{0,2}}[\s:#]*$", re.I)
DECOY_BEHIND = re.compile(r"^\s*(?:kg|g|mm|cm|m|km|ml|hours|minutes|pieces|parts|pages|people|copies|percent|%|°)(?!\w)", re.I)
DATE = re.compile(r"^(?:\d{1,2}[./-]\d{1,2}[./-]\d{2,4}|\d{4}[./-]\d{1,2}[./-]\d{1,2})$")
# where the slower patterns are tried at all; each begins with a set of characters, which is quick to search for
NAME_HERE = re.compile(r"[A-ZÀ-ŽА-ЯЁ][\w'’.-]*,? [A-ZÀ-ŽА-ЯЁ]")
NUMBER_HERE = re.compile(r"[A-Z0-9+(][A-Z0-9 ()./+-]{5,}")
ADDRESS_HERE = re.compile(r"[0-9][A-Za-z]?(?:\s?bis|\s?ter)?,?\s(?:[A-ZÀ-Þ]|rue|avenue|boulevard|place|chemin|allée|impasse|quai)")
#: endings and beginnings of streets that are not told by a number before a capital letter
STREETS_HERE = ("Box", "traße ", "trasse ", "str. ", "Str. ", "weg ", "allee ", "platz ", "gasse ", "ring ", "damm ", "Weg ", "alle ", "venida ", "vda. ", "laza ", "aseo ", "Rua ", "rua ", "avessa ", "argo ", "Via ", "via ", "iazza ", "ul. ", "al. ", "ул. ")


def _address_places(text: str) -> list[int]:
    at = [m.start() for m in ADDRESS_HERE.finditer(text)]
    for word in STREETS_HERE:
        k = text.find(word)
        while k >= 0:
            at.append(k)
            k = text.find(word, k + 1)
    return sorted(at)


CELLS = 1 << 20  # counters of a word table


def word_cell(word: str) -> int:
    import xxhash

    return xxhash.xxh3_64_intdigest(word) % CELLS


class Words:
    """What the corpus says about words: ``at_cue``, in names at strong cues; ``low``, written in lower case."""

    def __init__(self, at_cue: np.ndarray | None = None, low: np.ndarray | None = None):
        self.at_cue, self.low, self.known = at_cue, low, {}

    def of(self, word: str) -> tuple[int, int]:
        if self.at_cue is None:
            return 0, 0
        got = self.known.get(word)
        if got is None:
            if len(self.known) > 200_000:
                self.known.clear()
            c = word_cell(word)
            got = self.known[word] = int(self.at_cue[c]), int(self.low[c])
        return got

    def ordinary(self, word: str) -> bool:
        """Written in lower case three times and more, and far more often than in names at cues."""
        cue, low = self.of(word)
        return low >= 3 and low > 10 * cue

    def in_names(self, word: str) -> bool:
        return word in GIVEN or self.of(word)[0] >= 2 and not self.ordinary(word)


NO_WORDS = Words()


def _stops(word: str, words: Words) -> bool:
    """No edge of a name; a capital letter with a full stop is an initial, whatever word it would be."""
    if len(word) == 2 and word[1] == ".":
        return False
    low = word.rstrip(",.").lower()
    return low in NOT_NAME_WORD or low not in GIVEN and words.ordinary(low)


def _names(text: str, known: Words = NO_WORDS):
    at = 0
    while (here := NAME_HERE.search(text, at)) is not None:
        m = NAME.match(text, here.start())
        if m is None:
            space = text.index(" ", here.start())
            at = space + 1
            continue
        a, at = m.span()
        words = [(w.start() + a, w.end() + a) for w in re.finditer(r"\S+", m[0])]
        while words and _stops(text[words[0][0] : words[0][1]], known):
            words.pop(0)
        while words and _stops(text[words[-1][0] : words[-1][1]], known):
            words.pop()
        if len(words) < 2:
            continue
        a, b = words[0][0], words[-1][1]
        span = text[a:b].rstrip(",")
        if all(len(w.strip(".,")) < 2 for w in span.split()):
            continue
        if span.endswith(".") and not re.search(r"[ ,][A-ZÀ-Þ]\.$", span):
            span = span[:-1]
        yield a, a + len(span)


def _numbers(text: str):
    for here in NUMBER_HERE.finditer(text):
        a, b = here.span()
        if sum(c.isdigit() for c in here[0]) < 4:
            continue
        a, b = max(0, a - 3), min(len(text), b + 4)
        for m in PHONE.finditer(text, a, b):
            if 7 <= sum(c.isdigit() for c in m[0]) <= 15 and not DATE.match(m[0]) and m.end() < here.end() + 2:
                yield m.start(), m.end(), "phone"
        for m in ID.finditer(text, a, b):
            if sum(c.isdigit() for c in m[0]) >= 4 and m.end() < here.end() + 2:
                yield m.start(), m.end(), "id_number"


WORD_START = re.compile(r"(?<![\w-])[\w]")


def _address(text: str, low: int, here: int):
    """The address that begins at a word up to 40 characters before the word at ``here``, or at that one."""
    while here > low and (text[here - 1].isalnum() or text[here - 1] in "-.'’"):
        here -= 1
    for w in WORD_START.finditer(text, max(low, here - 40), min(len(text), here + 4)):
        if (m := ADDRESS.match(text, w.start())) is not None and m.end() > here:
            return m
    return None


def candidates(text: str, words: Words = NO_WORDS):
    """(start, end, kind) of all candidate spans."""
    if "@" in text or "at]" in text or "(at)" in text or " dot " in text or "{at}" in text:
        for m in EMAIL.finditer(text):
            yield m.start(), m.end(), "email"
    yield from _numbers(text)
    at = 0
    for here in _address_places(text):
        if here >= at:
            if (m := _address(text, at, here)) is not None:
                yield m.start(), m.end(), "address"
                at = m.end()
    for a, b in _names(text, words):
        yield a, b, "person_name"


STRICT_PHONE = re.compile(r"^(?:\+\d[\d ().-]{7,}|00\d{2,3}[-. ]\d.*|0\d{4} \d{3} \d{3,4}|0\d{2,4} \d{3,5} \d{3,4}|\(\d{3}\) \d{3}-\d{4}|\d{3}-\d{3}-\d{4})$")
STRICT_ID = re.compile(rf"^(?:{'|'.join(ID_FORMS[:6])})$")
STRICT_ADDRESS = re.compile(rf",|{POST}|Box")
LABELERS = ("strict", "before", "behind", "decoy", "gazetteer", "form")


def votes(text: str, a: int, b: int, kind: str, known: Words) -> tuple[int, ...]:
    """One vote per labeler: 1 for, -1 against, 0 no opinion."""
    span, left, right = text[a:b], text[max(0, a - 40) : a], text[b : b + 40]
    decoy = -1 if DECOY_BEFORE.search(left) or DECOY_BEHIND.match(right) else 0
    if kind == "person_name":
        words = [w.strip(".") for w in re.split(r"[ ,-]+", span) if len(w.strip(".")) > 1]
        low = [w.lower() for w in words if w[0].isupper()]
        named = sum(map(known.in_names, low))
        against = any(w in NOT_NAME_WORD or known.ordinary(w) and w not in GIVEN for w in low)
        return (
            0,
            1 if NAME_CUE.search(left) else 0,
            1 if NAME_CUE_BEHIND.match(right) else 0,
            -1 if against else decoy,
            1 if low and (2 * named >= len(low) or low[0] in GIVEN) else 0 if named or not any(map(known.ordinary, low)) else -1,
            -1 if len({w.isupper() for w in words}) > 1 or len(span.split()) > 5 else 0,
        )
    if kind == "email":
        return (1 if "@" in span else 0, 0, 0, 0, 0, 1 if re.search(r"[a-z0-9]", span, re.I) else -1)
    if kind == "phone":
        return (
            1 if STRICT_PHONE.match(span) else 0,
            1 if PHONE_CUE.search(left) else 0,
            0,
            -1 if decoy or ID_CUE.search(left) or ID_BEHIND.match(right) else 0,
            0,
            1 if span[0] in "+(0" else -1,
        )
    if kind == "id_number":
        return (
            1 if STRICT_ID.match(span) else 0,
            1 if ID_CUE.search(left) else 0,
            1 if ID_BEHIND.match(right) else 0,
            -1 if decoy or PHONE_CUE.search(left) else 0,
            0,
            -1 if re.match(r"^(?:ORD|INV|SN|RK)", span) else 0,
        )
    return (1 if STRICT_ADDRESS.search(span) else 0, 1 if ADDRESS_CUE.search(left) else 0, 0, decoy, 0, 1 if re.search(r"\d", span) else -1)


HASHED = 1 << 14


def features(text: str, a: int, b: int, kind: str, vote: tuple[int, ...]) -> list[int]:
    """Hashed features: votes, words around, the span's form."""
    import xxhash

    left, right = re.findall(r"\w+|[^\w\s]", text[max(0, a - 40) : a])[-3:], re.findall(r"\w+|[^\w\s]", text[b : b + 40])[:3]
    form = re.sub(r"\d", "0", re.sub(r"[a-zà-ÿ]+", "a", re.sub(r"[A-ZÀ-Þ]", "A", text[a:b])))[:40]
    out = [f"k{kind}", f"f{kind}{form}", f"v{kind}{vote}"]
    out += [f"{kind}{n}{v}" for n, v in zip(LABELERS, vote) if v]
    out += [f"l{kind}{k}{w.lower()}" for k, w in enumerate(reversed(left))] + [f"r{kind}{k}{w.lower()}" for k, w in enumerate(right)]
    out += [f"L{kind}{' '.join(left[-2:]).lower()}", f"R{kind}{' '.join(right[:2]).lower()}"]
    return [xxhash.xxh3_64_intdigest(x) % HASHED for x in out]


QUIET = 0.75  # weight of a missing opinion


def estimate(counts: dict[tuple[str, tuple[int, ...]], int], rounds: int = 60) -> dict[tuple[str, tuple[int, ...]], float]:
    """Expectation-maximisation on vote patterns: each kind has its prior, each labeler its table of votes given the truth.

    A labeler without opinion says only a part of what its table makes of it, as mentions often stand without any cue. Starts
    from the belief that labelers are right four times in five."""
    out = {}
    for kind in KINDS:
        rows = [(p, n) for (k, p), n in counts.items() if k == kind]
        if not rows:
            continue
        v, n = np.array([p for p, _ in rows]), np.array([c for _, c in rows], float)
        table = np.log(np.array([[0.3, 0.5, 0.2], [0.05, 0.5, 0.45]]))  # truth 0, 1: votes -1, 0, 1
        like = np.repeat(table[None], v.shape[1], 0)
        prior = 0.5
        anchor = np.array([[3.0, 5.0, 2.0], [0.5, 5.0, 4.5]])
        for _ in range(rounds):
            score = np.zeros((len(v), 2))
            for j in range(v.shape[1]):
                score += np.where(v[:, j] == 0, QUIET, 1.0)[:, None] * like[j][:, v[:, j] + 1].T
            score += np.log([1 - prior, prior])
            post = 1 / (1 + np.exp(np.clip(score[:, 0] - score[:, 1], -50, 50)))
            prior = float(np.clip((n * post).sum() / n.sum(), 0.02, 0.98))
            scale = max(1.0, n.sum() / 200)
            for j in range(v.shape[1]):
                for truth, w in ((0, n * (1 - post)), (1, n * post)):
                    c = np.array([w[v[:, j] == x].sum() for x in (-1, 0, 1)]) + anchor[truth] * scale
                    like[j][truth] = np.log(c / c.sum())
        out.update({(kind, p): float(x) for (p, _), x in zip(rows, post)})
    return out


def fit_classifier(rows: list[list[int]], targets: np.ndarray, weights: np.ndarray, rounds: int = 200) -> np.ndarray:
    """Logistic regression on hashed features by gradient steps; HASHED weights and the constant."""
    w = np.zeros(HASHED + 1, np.float64)
    if not rows:
        return w
    size = np.array([len(r) for r in rows])
    flat, owner = np.concatenate([np.array(r) for r in rows]), np.repeat(np.arange(len(rows)), size)
    squares = np.full(HASHED + 1, 1e-6)
    for _ in range(rounds):
        z = np.bincount(owner, weights=w[flat], minlength=len(rows)) + w[-1]
        g = (1 / (1 + np.exp(-np.clip(z, -40, 40))) - targets) * weights
        grad = np.bincount(flat, weights=g[owner], minlength=HASHED + 1)
        grad[-1] = g.sum()
        grad = grad / weights.sum() + 1e-5 * w
        squares = 0.9 * squares + 0.1 * grad * grad
        w -= 0.1 * grad / np.sqrt(squares + 1e-12)
    return w


def _texts(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return df.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text")).where("id is not null and text is not null and text <> ''")


LOWER = re.compile(r"(?<![\w@.])[^\W\d_A-ZÀ-ÖØ-ÞА-ЯЁ][^\W\d_]+(?![\w@])")
RANGES = 16  # rows of a count table


def count_words(texts: DataFrame) -> Words:
    """The word tables, over all texts; a driver-side result of fixed size."""

    width = CELLS // RANGES

    def run(batches):
        import xxhash

        cells: dict[str, int] = {}
        tables = {"cue": np.zeros(CELLS, np.int64), "low": np.zeros(CELLS, np.int64)}
        for batch in batches:
            counts = {"cue": Counter(), "low": Counter()}
            for t in batch.column(1).to_pylist():
                counts["low"].update(LOWER.findall(t))
                for a, b in _names(t):
                    if NAME_CUE.search(t[max(0, a - 40) : a]) or NAME_CUE_BEHIND.match(t[b : b + 40]):
                        if not DECOY_BEFORE.search(t[max(0, a - 40) : a]):
                            counts["cue"].update(w.lower().strip(".") for w in re.split(r"[ ,-]+", t[a:b]) if len(w.strip(".")) > 1)
            for name, n in counts.items():
                for w, k in n.items():
                    c = cells.get(w)
                    if c is None:
                        if len(cells) > 500_000:
                            cells.clear()
                        c = cells[w] = xxhash.xxh3_64_intdigest(w) % CELLS
                    tables[name][c] += k
        rows = [(n, k, t[k * width : (k + 1) * width].tobytes()) for n, t in tables.items() if t.any() for k in range(RANGES)]
        yield pa.RecordBatch.from_pydict({"name": pa.array([r[0] for r in rows], pa.string()), "part": pa.array([r[1] for r in rows], pa.int32()), "counts": pa.array([r[2] for r in rows], pa.binary())})

    def add(whole: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(x, np.int64) for x in whole.column("counts").to_pylist())
        return pa.table({"name": whole.column("name")[:1], "part": whole.column("part")[:1], "counts": [total.tobytes()]})

    out = {"cue": np.zeros((RANGES, width), np.int64), "low": np.zeros((RANGES, width), np.int64)}
    for r in texts.mapInArrow(run, "name string, part int, counts binary").groupBy("name", "part").applyInArrow(add, "name string, part int, counts binary").collect():  # 2 * RANGES rows
        out[r["name"]][r["part"]] = np.frombuffer(r["counts"], np.int64)
    small = {k: np.minimum(v.ravel(), 1 << 30).astype(np.int32) for k, v in out.items()}
    return Words(small["cue"], small["low"])


class Finder:
    """The fitted model; of fixed size, sent to all executors."""

    def __init__(self, words: Words, weights: np.ndarray, probability: dict):
        self.words, self.weights, self.probability = words, weights.astype(np.float32), probability

    def score(self, vote: tuple[int, ...], feats: list[int]) -> float:
        if not self.weights.any():
            return 0.5 + 0.1 * sum(vote)
        z = float(self.weights[feats].sum() + self.weights[-1])
        return 1 / (1 + math.exp(-max(-40.0, min(40.0, z))))

    def choose(self, spans: list[tuple[int, int, str, tuple[int, ...], list[int]]]) -> list[tuple[int, int, str]]:
        scored = [(p, b - a, a, b, kind) for a, b, kind, vote, feats in spans if (p := self.score(vote, feats)) >= 0.5]
        taken: list[tuple[int, int, str]] = []
        for _, _, a, b, kind in sorted(scored, key=lambda x: (-round(x[0], 2), -x[1], x[2], x[4])):
            if all(b <= x or a >= y for x, y, _ in taken):
                taken.append((a, b, kind))
        return sorted(taken)

    def find(self, text: str) -> list[tuple[int, int, str]]:
        return self.choose(list(spans_of(text, self.words)))

    def redact(self, text: str) -> str:
        out, at = [], 0
        for a, b, kind in self.find(text):
            out += [text[at:a], f"[{kind.upper()}]"]
            at = b
        return "".join([*out, text[at:]])


def spans_of(text: str, words: Words):
    """(start, end, kind, votes, features) of all candidates."""
    for a, b, kind in candidates(text, words):
        vote = votes(text, a, b, kind, words)
        yield a, b, kind, vote, features(text, a, b, kind, vote)


SPANS = "id string, spans array<struct<a:int,b:int,kind:string,value:string,votes:string,features:array<int>>>"


def span_table(df: DataFrame, words: Words, id_col: str, text_col: str) -> DataFrame:
    """(id, spans): the candidates of every text that has any, written to the shared folder."""
    shared = df.sparkSession.sparkContext.broadcast((words.at_cue, words.low))
    kind = pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32()), ("kind", pa.string()), ("value", pa.string()), ("votes", pa.string()), ("features", pa.list_(pa.int32()))]))

    def run(batches):
        known = Words(*shared.value)
        for batch in batches:
            ids, out = [], []
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                spans = [{"a": a, "b": b, "kind": k, "value": t[a:b], "votes": ",".join(map(str, v)), "features": f} for a, b, k, v, f in spans_of(t, known)]
                if spans:
                    ids.append(i)
                    out.append(spans)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array(out, kind)], ["id", "spans"])

    return cut(_texts(df, id_col, text_col).mapInArrow(run, SPANS), "personal-spans")


def fit(spans: DataFrame, words: Words, sample: int = 20_000, per_pattern: int = 200) -> Finder:
    """Estimates the labelers and fits the classifier on at most ``sample`` candidates, ``per_pattern`` of each vote pattern, chosen by hash."""
    each = spans.select("id", F.explode("spans").alias("s")).select("id", "s.kind", "s.votes", "s.features", F.xxhash64("id", "s.a", "s.kind").alias("h"))
    got = each.groupBy("kind", "votes").agg(F.count("*").alias("n")).collect()  # one row per pattern of votes
    if not got:
        return Finder(words, np.zeros(HASHED + 1), {})
    parse = lambda v: tuple(map(int, v.split(",")))
    counts = {(r["kind"], parse(r["votes"])): r["n"] for r in got}
    probability = estimate(counts)
    most = max(1, min(per_pattern, sample // len(got)))
    w = Window.partitionBy("kind", "votes").orderBy("h", "id")
    some = each.withColumn("r", F.row_number().over(w)).where(F.col("r") <= most).orderBy("kind", "votes", "r").collect()  # bounded by ``sample``
    taken = Counter((r["kind"], parse(r["votes"])) for r in some)
    keys = [(r["kind"], parse(r["votes"])) for r in some]
    return Finder(words, fit_classifier([r["features"] for r in some], np.array([probability[k] for k in keys]), np.array([math.sqrt(counts[k]) / taken[k] for k in keys])), probability)


def train(df: DataFrame, id_col: str = "id", text_col: str = "text", sample: int = 20_000) -> tuple[Finder, DataFrame]:
    """The model, and the candidates of ``df`` (see ``span_table``)."""
    words = count_words(_texts(df, id_col, text_col))
    spans = span_table(df, words, id_col, text_col)
    return fit(spans, words, sample), spans


def mentions(finder: Finder, spans: DataFrame) -> DataFrame:
    """(id, kind, found_value): each distinct mention among the candidates."""
    shared = spans.sparkSession.sparkContext.broadcast((finder.weights, finder.probability))

    def run(batches):
        model = Finder(NO_WORDS, *shared.value)
        for batch in batches:
            out = []
            for i, cands in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                value = {(c["a"], c["b"]): c["value"] for c in cands}
                out += [(i, k, value[a, b]) for a, b, k in model.choose([(c["a"], c["b"], c["kind"], tuple(map(int, c["votes"].split(","))), c["features"]) for c in cands])]
            yield pa.RecordBatch.from_pydict({n: pa.array([r[c] for r in out], pa.string()) for c, n in enumerate(("id", "kind", "found_value"))})

    return spans.mapInArrow(run, "id string, kind string, found_value string").distinct()


def redacted(df: DataFrame, finder: Finder, id_col: str = "id", text_col: str = "text") -> DataFrame:
    """(id, text): texts with at least one mention, placeholders in its place."""
    shared = df.sparkSession.sparkContext.broadcast((finder.words.at_cue, finder.words.low, finder.weights, finder.probability))

    def run(batches):
        at_cue, low, weights, probability = shared.value
        model = Finder(Words(at_cue, low), weights, probability)
        for batch in batches:
            out = [(i, n) for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) if (n := model.redact(t)) != t]
            yield pa.RecordBatch.from_pydict({"id": pa.array([r[0] for r in out], pa.string()), "text": pa.array([r[1] for r in out], pa.string())})

    return _texts(df, id_col, text_col).mapInArrow(run, "id string, text string").dropDuplicates(["id"])
