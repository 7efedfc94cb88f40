"""Personal data by a semi-Markov conditional random field over whole spans.

Rules find plain e-mail addresses, network addresses, payment cards and phone numbers exactly. The field then looks at
islands of words around a digit, an at sign, a bracketed at or a spelled-out dot: every run of up to MAX_WORDS words there is a
candidate segment, scored as a whole (digit groups, separators, checksum, neighbouring word), and dynamic programming
over segments of bounded length (at most MAX_WORDS words and MAX_CHARS code points; e-mail addresses MAX_EMAIL, cards MAX_CARD, phone numbers MAX_PHONE) chooses boundaries and types together. Words outside islands cannot start or end a
candidate, and a word outside all segments scores 0, so deciding island by island equals deciding over the whole text. Segments that the best
path holds with a marginal probability of at least MIN_PROBABILITY and that meet no rule's span are added.

The field is fitted by stochastic gradient on at most SAMPLE_ISLANDS islands of the corpus (from about SAMPLE_DOCS documents, chosen by the hash of their text, in islands of at most MAX_TRAINED code points), labelled by the rules, and on
disguised and look-alike spans made from fixed forms; both bounds hold for any input.

Defined results: a null or empty text has no spans; repeated rows are read one by one; offsets are code points; time
is linear in the text, whatever runs of digits or name characters it has; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import math
import random
import re
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import source_rows

KINDS = ("email", "ip", "card", "phone")
MAX_WORDS = 11
#: The longest segments, in code points: of any type, and those of each type that may take part.
MAX_CHARS, MAX_EMAIL, MAX_CARD, MAX_PHONE = 160, 120, 40, 30
#: Longer islands are not trained on (they are searched).
MAX_TRAINED = 2000
SIDE_WORDS = 4
MIN_PROBABILITY = 0.9
SAMPLE_ISLANDS, SAMPLE_DOCS = 600, 4000
SYNTHETIC = 60
EPOCHS = 12

_domain = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_local = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_ip = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
_card = re.compile(r"[0-9](?:[ -]?[0-9])+")
_phone = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_not_digit = re.compile(r"[^0-9]+")
_trigger = re.compile(r"[0-9@]|[\[({]at[\])}]|(?<![^\s\[({])dot(?![^\s\])}])", re.I)
_words = re.compile(r"\S+")


def luhn(digits: str) -> bool:
    odd = sum(map(int, digits[-1::-2]))
    return (odd + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])) % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost non-overlapping matches; found from their at signs, since a name's start is where its run of name characters starts."""
    out, last, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in _local:
            start -= 1
        if start < at and (m := _domain.match(text, at + 1)):
            out.append((start, m.end()))
            last = m.end()
        else:
            last = max(last, at)
        at = text.find("@", max(at + 1, last))
    return out


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """The rules' spans, by kind and start."""
    out = [("email", s, e) for s, e in emails(text)]
    for m in _ip.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            out.append(("ip", *m.span()))
    for m in _card.finditer(text):
        if m.end() - m.start() <= 40 and 13 <= len(d := _not_digit.sub("", m[0])) <= 19 and luhn(d):
            out.append(("card", *m.span()))
    if "+" in text:
        for m in _phone.finditer(text):
            if 9 <= sum(c in "0123456789" for c in m[0]) <= 15:
                out.append(("phone", *m.span()))
    return out


def islands(text: str) -> list[list[tuple[int, int]]]:
    """Word spans around triggers; islands that touch are one."""
    if not _trigger.search(text):
        return []
    words = [m.span() for m in _words.finditer(text)]
    marks, k = [], 0
    for m in _trigger.finditer(text):
        while words[k][1] <= m.start():
            k += 1
        if not marks or marks[-1] != k:
            marks.append(k)
    out, low, high = [], None, None
    for k in marks:
        if low is not None and k - SIDE_WORDS <= high:
            high = min(len(words), k + SIDE_WORDS + 1)
            continue
        if low is not None:
            out.append(words[low:high])
        low, high = max(0, k - SIDE_WORDS), min(len(words), k + SIDE_WORDS + 1)
    if low is not None:
        out.append(words[low:high])
    return out


def trimmed(text: str, start: int, end: int) -> tuple[int, int]:
    """Without quotes, brackets and stops around a span; a bracket with its partner inside stays."""
    while start < end and text[start] in "\"'<[{,;:":
        start += 1
    while start < end and text[end - 1] in "\"'>]},;:.!?":
        end -= 1
    if text[start:end].count("(") > text[start:end].count(")") and text[start : start + 1] == "(":
        start += 1
    elif text[start:end].count(")") > text[start:end].count("(") and text[end - 1 : end] == ")":
        end -= 1
    return start, end


_at_word = re.compile(r"(?:^|\s)(?:at|\(at\)|\[at\]|\{at\})(?:\s|$)|[\[({]at[\])}]", re.I)
_dot_word = re.compile(r"(?:^|\s)dot(?:\s|$)|[\[({]dot[\])}]", re.I)
_shape = re.compile(r"[A-Za-z]+|[0-9]+")


def possible(span: str) -> tuple[str, ...]:
    """The types that a segment may take at all."""
    digits = sum("0" <= c <= "9" for c in span)
    letters = any(c.isalpha() for c in span)
    out = []
    if letters and ("@" in span or _at_word.search(span)) and ("." in span or _dot_word.search(span)) and len(span) <= MAX_EMAIL:
        out.append("email")
    groups = re.split(r"[^0-9]+", span.strip())
    if not letters or _dot_word.search(span):
        if 4 <= digits <= 12 and len([g for g in groups if g]) == 4 and (span.count(".") == 3 or len(_dot_word.findall(span)) >= 2 or "[.]" in span):
            out.append("ip")
    if not letters and 13 <= digits <= 19 and len(span) <= MAX_CARD:
        out.append("card")
    if not letters and 9 <= digits <= 15 and len(span) <= MAX_PHONE:
        out.append("phone")
    return tuple(out)


def features(text: str, start: int, end: int, before: str) -> list[str]:
    span = text[start:end]
    groups = [g for g in re.split(r"[^0-9]+", span) if g]
    digits = "".join(groups)
    shape = _shape.sub(lambda m: "a" if m[0][0].isalpha() else f"9{min(len(m[0]), 6)}", span)
    found = [
        "bias", f"n{min(len(digits), 20)}", f"g{'-'.join(str(min(len(g), 9)) for g in groups[:6])}", f"seps{''.join(sorted(set(re.sub(r'[A-Za-z0-9]', '', span))))[:6]}",
        f"first{span[:1] if not span[:1].isalnum() else 'x'}", f"w{span.count(' ')}", f"shape{shape[:24]}", f"before{before[-12:].lower().strip(':.,')}" if before[:1].isalpha() else "before-",
    ]
    if len(digits) >= 13:
        found.append("luhn" if luhn(digits) else "not-luhn")
    if len(groups) == 4:
        found.append("octets" if all(int(g) <= 255 for g in groups if len(g) < 5) and max(map(len, groups)) <= 3 else "not-octets")
    if re.search(r"\.[A-Za-z]{2,6}$|dot[\])}]?\s*[A-Za-z]{2,6}$", span, re.I):
        found.append("top-domain")
    if "@" in span:
        found.append("at")
    if _at_word.search(span):
        found.append("at-word")
    if len(set(groups)) == 1 and len(groups) == 1:
        found.append("one-run")
    return found


def candidates(text: str, words: list[tuple[int, int]]) -> list[tuple[int, int, str, list[str]]]:
    """(first word, word after the last, type, features) of every segment that some type allows."""
    out = []
    has = [bool(_trigger.search(text[s:e])) or text[s:e].lower() in ("at", "(at)", "[at]") for s, e in words]
    for i in range(len(words)):
        before = text[words[i - 1][0] : words[i - 1][1]] if i else ""
        for j in range(i + 1, min(len(words), i + MAX_WORDS) + 1):
            if not any(has[i:j]) or words[j - 1][1] - words[i][0] > MAX_CHARS:
                continue
            start, end = trimmed(text, words[i][0], words[j - 1][1])
            if start < end and (types := possible(text[start:end])):
                f = features(text, start, end, before)
                out += [(i, j, t, f) for t in types]
    return out


class Field:
    """Weights by (type, feature); a word outside all segments scores 0."""

    def __init__(self, weights: dict | None = None) -> None:
        self.weights = defaultdict(float, weights or {})

    def scores(self, segs: list) -> list[float]:
        w = self.weights
        return [sum(w.get((t, f), 0.0) for f in fs) for _, _, t, fs in segs]

    @staticmethod
    def sums(n: int, segs: list, scores: list[float]) -> tuple[list[float], list[float]]:
        """log of the total weight of all paths up to and from each word boundary."""
        ends, starts = defaultdict(list), defaultdict(list)
        for s, (i, j, _, _) in zip(scores, segs, strict=True):
            ends[j].append((i, s))
            starts[i].append((j, s))

        def add(xs: list[float]) -> float:
            top = max(xs)
            return top + math.log(sum(math.exp(x - top) for x in xs))

        fore = [0.0] * (n + 1)
        for k in range(1, n + 1):
            fore[k] = add([fore[k - 1]] + [fore[i] + s for i, s in ends[k]]) if ends[k] else fore[k - 1]
        back = [0.0] * (n + 1)
        for k in range(n - 1, -1, -1):
            back[k] = add([back[k + 1]] + [back[j] + s for j, s in starts[k]]) if starts[k] else back[k + 1]
        return fore, back

    def learn(self, n: int, segs: list, gold: set, rate: float, grads: dict) -> None:
        """One step up the log-likelihood of the path whose segments are gold (AdaGrad)."""
        scores = self.scores(segs)
        fore, back = self.sums(n, segs, scores)
        for s, (i, j, t, fs) in zip(scores, segs, strict=True):
            g = ((i, j, t) in gold) - math.exp(min(0.0, fore[i] + s + back[j] - fore[n]))
            if abs(g) > 1e-4:
                for f in fs:
                    key = (t, f)
                    grads[key] += g * g
                    self.weights[key] += rate * g / math.sqrt(grads[key] + 1e-8) - 1e-4 * self.weights[key]

    def decode(self, n: int, segs: list) -> list[tuple[int, int, str, float]]:
        """The best path's segments with their marginal probabilities."""
        scores = self.scores(segs)
        ends = defaultdict(list)
        for k, (_, j, _, _) in enumerate(segs):
            ends[j].append(k)
        best, back = [0.0] * (n + 1), [None] * (n + 1)
        for j in range(1, n + 1):
            best[j], back[j] = best[j - 1], None
            for k in ends[j]:
                if best[segs[k][0]] + scores[k] > best[j]:
                    best[j], back[j] = best[segs[k][0]] + scores[k], k
        out, j = [], n
        while j:
            if back[j] is None:
                j -= 1
            else:
                out.append(back[j])
                j = segs[back[j]][0]
        if not out:
            return []
        fore, rear = self.sums(n, segs, scores)
        return [(segs[k][0], segs[k][1], segs[k][2], math.exp(min(0.0, fore[segs[k][0]] + scores[k] + rear[segs[k][1]] - fore[n]))) for k in reversed(out)]


def synthetic(n: int = SYNTHETIC, seed: int = 7) -> list[tuple[str, list[tuple[str, int, int]]]]:
    """Texts with disguised spans, and look-alikes without any: n of each form, from fixed forms and seeded numbers."""
    rnd = random.Random(seed)
    num = lambda k: "".join(rnd.choice("0123456789") for _ in range(k))
    word = lambda: "".join(rnd.choice("abcdefghijklmnoprstuvw") for _ in range(rnd.randint(3, 8)))

    def name() -> str:
        return rnd.choice((word(), f"{word()}.{word()}", f"{word()}{num(2)}", f"{word()}_{word()}"))

    def card() -> str:
        d = rnd.choice("456") + num(14)
        return next(d + c for c in "0123456789" if luhn(d + c))

    def octets() -> list[str]:
        return [str(rnd.randint(1, 254)) for _ in range(4)]

    c4 = lambda sep: sep.join((d := card())[i : i + 4] for i in range(0, 16, 4))
    spans = {
        "email": [
            lambda: f"{name()} at {word()} dot com", lambda: f"{name()}[at]{word()}.org", lambda: f"{name()} [at] {word()} [dot] {rnd.choice(('net', 'org', 'com'))}", lambda: f"{name()}(at){word()}.com",
            lambda: f"{name()} (at) {word()}.{word()}.com", lambda: f"{name()} @ {word()}.com", lambda: f"{name()}@{word()}.com",
        ],
        "ip": [lambda: "[.]".join(octets()), lambda: ".".join(octets()), lambda: " dot ".join(octets())],
        "card": [lambda: c4("."), lambda: c4("/"), lambda: c4("-"), lambda: c4(" "), card],
        "phone": [lambda: f"({num(3)}) {num(3)}-{num(4)}", lambda: f"{num(3)}-{num(3)}-{num(4)}", lambda: f"{num(3)}.{num(3)}.{num(4)}", lambda: f"+{num(1)} ({num(3)}) {num(3)}-{num(4)}", lambda: f"00{num(2)} {num(3)} {num(3)} {num(3)}", lambda: f"1-{num(3)}-{num(3)}-{num(4)}"],
    }
    clean = [
        lambda: f"version {num(1)}.{num(1)}.{num(2)}", lambda: f"20{num(2)}-0{rnd.randint(1, 9)}-1{num(1)}", lambda: f"{num(2)}:{num(2)}:{num(2)}", lambda: f"order {num(rnd.randint(5, 12))}", lambda: f"{num(16)}"[:15] + "x",
        lambda: f"{rnd.randint(300, 999)}.{rnd.randint(300, 999)}.{num(3)}.{num(3)}", lambda: f"ISBN 978-{num(1)}-{num(2)}-{num(6)}-{num(1)}", lambda: f"{num(2)}.{num(3)}.{num(3)},{num(2)}", lambda: f"at {num(1)} dot {num(1)}", lambda: f"section {num(1)}.{num(1)}.{num(1)}.{num(1)}.{num(1)}",
        lambda: f"{num(10)}", lambda: f"{num(3)},{num(3)},{num(3)}", lambda: f"@{word()}", lambda: f"{num(4)} - {num(4)}", lambda: f"pages {num(3)}-{num(3)}", lambda: f"look at {word()} . com", lambda: f"{num(9)}-{num(5)}", lambda: f"id {num(13)}", lambda: f"{num(4)} {num(4)} {num(4)}",
    ]
    out = []
    for _ in range(n):
        for kind, forms in spans.items():
            for form in forms:
                head, s = f"{word()} {word()} ", form()
                if kind == "phone" or kind != "card" or luhn(re.sub(r"[^0-9]", "", s)):
                    out.append((f"{head}{s} {word()} {word()}.", [(kind, len(head), len(head) + len(s))]))
        out += [(f"{word()} {form()} {word()} {word()}", []) for form in clean]
    return out


def prepared(text: str, spans: list[tuple[str, int, int]]) -> list[tuple[int, list, set]]:
    """(words, candidate segments, gold segments) of each island of a labelled text; islands whose spans no segment fits are left out."""
    out = []
    for words in islands(text):
        segs = candidates(text, words)
        inside = {(k, s, e) for k, s, e in spans if s >= words[0][0] and e <= words[-1][1]}
        gold = set()
        for i, j, t, _ in segs:
            if (t, *trimmed(text, words[i][0], words[j - 1][1])) in inside:
                gold.add((i, j, t))
        starts = [w for g in gold for w in range(g[0], g[1])]
        if segs and len(starts) == len(set(starts)) and len(gold) == len(inside):
            out.append((len(words), segs, gold))
    return out


def fit(labelled: list[tuple[str, list[tuple[str, int, int]]]], epochs: int = EPOCHS, seed: int = 3) -> Field:
    """The field's weights from labelled texts (bounded by the caller) and synthetic ones."""
    examples = [x for text, spans in labelled + synthetic() for x in prepared(text, spans)]
    field, grads, rnd = Field(), defaultdict(float), random.Random(seed)
    for _ in range(epochs):
        rnd.shuffle(examples)
        for n, segs, gold in examples:
            field.learn(n, segs, gold, 0.3, grads)
    return field


def all_spans(text: str, field: Field) -> tuple[list, list]:
    """(rule spans, all spans), both by kind and start."""
    base = base_spans(text)
    taken = sorted((s, e) for _, s, e in base)
    added = []
    for words in islands(text):
        segs = candidates(text, words)
        if not segs:
            continue
        for i, j, kind, p in field.decode(len(words), segs):
            s, e = trimmed(text, words[i][0], words[j - 1][1])
            if p >= MIN_PROBABILITY and not any(a < e and s < b for a, b in taken):
                added.append((kind, s, e))
    order = {k: i for i, k in enumerate(KINDS)}
    return base, sorted(base + added, key=lambda x: (order[x[0]], x[1]))


def _sample(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Island texts with their rule spans as JSON-free columns, keyed by a hash for a fixed choice."""
    for b in it:
        keys, texts, spans = [], [], []
        for t in b.column(0):
            text = t.as_py()
            base = base_spans(text)
            for words in islands(text):
                low, high = words[0][0], words[-1][1]
                if high - low > MAX_TRAINED:
                    continue
                own = [(k, s - low, e - low) for k, s, e in base if s >= low and e <= high]
                texts.append(text[low:high])
                spans.append(";".join(f"{k}:{s}:{e}" for k, s, e in own))
                keys.append(hashlib.md5(texts[-1].encode("utf-8", "surrogatepass")).hexdigest())
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(texts, pa.string()), pa.array(spans, pa.string())], ["key", "island", "spans"])


def train(docs: DataFrame, most: int = SAMPLE_ISLANDS) -> Field:
    """Fit on the `most` islands of docs with the smallest hash (only those reach the driver) and the synthetic ones."""
    marked = source_rows(docs, "text").where(F.col("text").rlike("[0-9@]"))
    share = min(1.0, SAMPLE_DOCS / max(1, marked.count()))  # so that the tasks together send a bounded number of islands
    marked = marked.where(F.pmod(F.xxhash64("text"), F.lit(1 << 40)) < int(share * (1 << 40)))
    chosen = marked.mapInArrow(_sample, "key string, island string, spans string").orderBy("key", "spans").limit(most).collect()
    read = lambda s: [(k, int(a), int(b)) for k, a, b in (x.split(":") for x in s.split(";") if x)]
    return fit([(r["island"], read(r["spans"])) for r in chosen])


def find(docs: DataFrame, field: Field) -> DataFrame:
    """doc_id, counts of rule spans, their hash, and all spans of every row of docs. No shuffle."""
    weights = docs.sparkSession.sparkContext.broadcast(dict(field.weights))  # bounded by the training sample
    names = ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"]

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Field(weights.value)
        joined = lambda spans: ",".join(f"{k}:{s}:{e}" for k, s, e in spans)
        for b in it:
            rows = []
            for i, t in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                base, spans = all_spans(t.as_py() or "", own)
                count = [sum(k == x for k, _, _ in base) for x in KINDS]
                rows.append((i, *count, hashlib.sha256(joined(base).encode()).hexdigest(), joined(spans)))
            kinds = [pa.int64()] * 5 + [pa.string()] * 2
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True) if rows else [[]] * 7, kinds, strict=True)], names)

    schema = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"
    return source_rows(docs, "doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("long")).mapInArrow(batches, schema)


def personal_data(docs: DataFrame) -> DataFrame:
    """train() on docs, then find() in them."""
    return find(docs, train(docs))
