"""Personal data: fixed base patterns, plus candidates judged by gradient-boosted trees.

High-recall generators propose spans that may overlap: obfuscated e-mail addresses, IPv6
and port-bearing addresses, digit groups like cards or telephone numbers that the base
patterns pass over. Boosted regression trees (logistic loss, numpy) score each candidate
by its format and its surroundings; a threshold per kind is calibrated on held-out
examples, and the best of overlapping candidates wins. The trees are fitted on examples
that `examples` writes from rules with a fixed seed; no table is read for it.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch_of, blocks

KINDS = ("email", "ip", "card", "phone")
#: Least precision on the held-out examples from which a kind's threshold is chosen.
PRECISION = 0.995

_IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_DIGIT = re.compile(r"[0-9]")
_NOT_DIGIT = re.compile(r"[^0-9]")
_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if k % 2:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost non-overlapping addresses. A match begins where the run of local characters before an @ begins."""
    out, floor, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > floor and text[start - 1] in _LOCAL_CHARS:
            start -= 1
        m = _DOMAIN.match(text, at) if start < at else None
        if m:
            out.append((start, m.end()))
            floor = m.end()
        at = text.find("@", max(at + 1, floor))
    return out


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the fixed patterns, by kind as listed, then start; code points, end exclusive."""
    out = [("email", a, b) for a, b in emails(text)] if "@" in text else []
    if _DIGIT.search(text):
        out += [("ip", m.start(), m.end()) for m in _IP.finditer(text) if max(map(_byte, m.group().split("."))) <= 255]
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 16:
                digits = _NOT_DIGIT.sub("", m.group())
                if 16 <= len(digits) <= 19 and luhn(digits):
                    out.append(("card", m.start(), m.end()))
        if "+" in text:
            out += [("phone", m.start(), m.end()) for m in _PHONE.finditer(text) if 8 <= len(_NOT_DIGIT.sub("", m.group())) <= 15]
    return out


def _byte(part: str) -> int:
    part = part.lstrip("0")
    return 256 if len(part) > 3 else int(part or "0")


# Candidates ----------------------------------------------------------------------------

_MASK_AT = re.compile(r" (?=at |AT )|[(\[{<](?= ?(?:at|AT|@) ?[)\]}>])")
_MASK_HEAD = re.compile(r"[A-Za-z0-9._%+-]+ ?(?:[(\[{<] ?(?:at|AT|@) ?[)\]}>]| at | AT ) ?[A-Za-z0-9-]+")
_MASK_PART = re.compile(r" ?(?:[(\[{<] ?(?:dot|DOT|\.) ?[)\]}>]|\.| dot | DOT ) ?[A-Za-z0-9-]{2,}")
_SIX = re.compile(r"(?<![0-9A-Za-z:])(?:[0-9A-Fa-f]{1,4}:){2,7}(?::?[0-9A-Fa-f]{1,4}){1,7}(?![0-9A-Za-z:])")
_GROUP = re.compile(r"[0-9]+")
_GAP = re.compile(r"[\x20().,:/_-]{1,2}")


def masked(text: str) -> list[tuple[int, int]]:
    """Obfuscated addresses around every at that could be one's, ending after each label but the first."""
    out = []
    for m in _MASK_AT.finditer(text):
        end = m.start() - (text[m.start() - 1 : m.start()] == " ")
        start = end
        while start > 0 and text[start - 1] in _LOCAL_CHARS:
            start -= 1
        part = _MASK_HEAD.match(text, start) if start < end else None
        while part:
            part = _MASK_PART.match(text, part.end())
            if part:
                out.append((start, part.end()))
    return out


def digit_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, end, digits) of every sequence of neighbouring digit groups that has 7 to 19 digits, with a ( or + before it."""
    groups, out = [m.span() for m in _GROUP.finditer(text)], []
    for i, (a, _) in enumerate(groups):
        n, end = 0, a
        for lo, hi in groups[i : i + 19]:
            n += hi - lo
            if n > 19 or lo > a and not _GAP.fullmatch(text, end, lo):
                break
            end = hi
            if n >= 7:
                out.append((a - (a > 0 and text[a - 1] in "(+"), end, n))
    return out


def candidates(text: str) -> list[tuple[str, int, int]]:
    """Spans worth a look, of every kind they could be; they may overlap."""
    out = [("email", a, b) for a, b in masked(text)]
    if not _DIGIT.search(text):
        return out
    if text.count(":") > 1:
        out += [("ip", m.start(), m.end()) for m in _SIX.finditer(text)]
    for a, b, n in digit_spans(text):
        if 13 <= n <= 19:
            out.append(("card", a, b))
        if n <= 15:
            out.append(("phone", a, b))
    return out


_NEAR = {
    "email": re.compile(r"mail|contact|write|reach|@|schreib|correo|courriel", re.I),
    "ip": re.compile(r"\bip|address|host|server|client|login|adress", re.I),
    "card": re.compile(r"card|visa|master|amex|credit|debit|pay|karte|tarjeta|carte", re.I),
    "phone": re.compile(r"tel|phone|call|mobile|cell|fax|whatsapp|ruf|llam|appel", re.I),
}
_AGAINST = re.compile(r"order|invoice|isbn|issn|version|serial|ticket|track|item|article|ref|doi|sku|batch|part|code|case|page|vol|date|time|license|no\.|nr\.|#$|id:?\s*$", re.I)
_DATE = re.compile(r"(?:19|20)[0-9]{2}[-/. ][0-9]{1,2}[-/. ][0-9]{1,2}|[0-9]{1,2}[-/.][0-9]{1,2}[-/.](?:19|20)[0-9]{2}|[0-9]{1,2}:[0-9]{2}")
_TLD = re.compile(r"(?<![A-Za-z0-9-])(?:com|org|net|edu|gov|info|io|de|fr|es|uk)$", re.I)
_BREAK = re.compile(r"[A-Za-z0-9-](?: \.|\. )")
#: Words that stand before "at" and a site or a place, and are nobody's name.
_NO_NAME = re.compile(r"(?:us|me|it|them|him|her|you|look|looks|looked|looking|available|found|hosted|posted|live|online|here|is|are|was|met|meet|visit|shop|page|site|website|arrived|dinner|stay|work|works|start|starts) ", re.I)


_CHAIN_LEFT = re.compile(r"(?:[0-9]+[\x20().,:/_-]{1,2})+$")
_LINK_RIGHT = re.compile(r"([\x20().,:/_-]{1,2})[0-9]")


def _link(gap: str) -> float:
    """0 without a gap, 1 for one that parts numbers, 2 for one that holds a number together."""
    return 0.0 if not gap else 1.0 if " " in gap or "," in gap else 2.0


def features(text: str, kind: str, a: int, b: int) -> list[float]:
    """Format and context of a candidate."""
    span, left, right = text[a:b], text[max(0, a - 32) : a], text[b : b + 16]
    digits = _NOT_DIGIT.sub("", span)
    groups = [len(g) for g in re.split(r"[^0-9]+", span) if g]
    before, after = left[-1:], right[:1]
    chain, link = _CHAIN_LEFT.search(left), _LINK_RIGHT.match(right)
    inner = {g for g in re.split(r"[0-9]+", span.lstrip("(+")) if g}
    return [
        float(KINDS.index(kind)),
        float(len(digits)),
        float(b - a),
        float(luhn(digits)) if digits else 0.0,
        float(len(groups)),
        float(max(groups, default=0)),
        float(min(groups, default=0)),
        float(len(set(digits))),
        float(groups == [4, 4, 4, 4] or len(groups) == 1 and len(digits) == 16 or groups == [4, 6, 5]),
        float(groups[-2:] == [3, 4] or groups[-3:] == [3, 3, 4]),
        float("(" in span or "+" in span),
        float(sum(c in ",:/_" for c in span)),
        float(span.count(".")),
        float(bool(_DATE.search(span))),
        float(before.isalnum() or before in {"_", "-", ".", "$", "€", "#", "="}),
        float(after.isalnum() or after in {"_", "%", "="}),
        float(bool(_NEAR[kind].search(left) or _NEAR[kind].search(right))),
        float(bool(_AGAINST.search(left))),
        float(sum(c in "([{<" for c in span)),
        float(span.lower().count("dot") + span.lower().count(" at ")),
        float(bool(_TLD.search(span))),
        _link(re.search(r"[^0-9]+$", left).group() if chain else ""),
        float(len(_GROUP.findall(chain.group())) if chain else 0),
        _link(link.group(1) if link else ""),
        float(span.count("(") != span.count(")")),
        float(len(inner)),
        float(any("," in g or "/" in g for g in inner)),
        float(groups in ([3, 3, 4], [1, 3, 3, 4], [2, 3, 3, 4])),
        float(len(_BREAK.findall(span))),
        float(bool(_NO_NAME.match(span))),
        float(kind == "email" and any(c in "._%+-0123456789" for c in re.split(r"[ (\[{<]", span, maxsplit=1)[0])),
    ]


# Boosted trees -------------------------------------------------------------------------


class BoostedTrees:
    """Depth-limited regression trees on logistic gradients; splits at the midpoints of distinct values."""

    def __init__(self, trees: int = 40, depth: int = 3, rate: float = 0.3, least: float = 2.0):
        self.trees, self.depth, self.rate, self.least = trees, depth, rate, least

    def fit(self, x: np.ndarray, y: np.ndarray) -> BoostedTrees:
        p = np.clip(y.mean(), 1e-3, 1 - 1e-3)
        self.start, self.model = float(np.log(p / (1 - p))), []
        cuts = [(np.unique(c)[1:] + np.unique(c)[:-1]) / 2 for c in x.T]
        cuts = [c if len(c) <= 32 else np.quantile(c, np.linspace(0, 1, 32)) for c in cuts]
        score = np.full(len(y), self.start)
        for _ in range(self.trees):
            p = 1 / (1 + np.exp(-score))
            tree = self._grow(x, y - p, p * (1 - p), np.arange(len(y)), cuts, 0)
            self.model.append(tree)
            score += self._walk(tree, x)
        return self

    def _grow(self, x, g, h, rows, cuts, level):
        gain, best = 1e-6, None
        gs, hs = g[rows].sum(), h[rows].sum()
        if level < self.depth:
            for f, values in enumerate(cuts):
                col = x[rows, f]
                for c in values:
                    low = col <= c
                    gl, hl = g[rows][low].sum(), h[rows][low].sum()
                    if min(hl, hs - hl) * 4 < self.least:
                        continue
                    won = gl * gl / (hl + 1) + (gs - gl) ** 2 / (hs - hl + 1) - gs * gs / (hs + 1)
                    if won > gain:
                        gain, best = won, (f, c, low)
        if best is None:
            return float(self.rate * gs / (hs + 1))
        f, c, low = best
        return (f, float(c), self._grow(x, g, h, rows[low], cuts, level + 1), self._grow(x, g, h, rows[~low], cuts, level + 1))

    def _walk(self, tree, x):
        if isinstance(tree, float):
            return np.full(len(x), tree)
        f, c, low, high = tree
        side = x[:, f] <= c
        out = np.empty(len(x))
        out[side], out[~side] = self._walk(low, x[side]), self._walk(high, x[~side])
        return out

    def predict(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(self.start + sum(self._walk(t, x) for t in self.model))))


def sentences(n: int, seed: int) -> list[tuple[str, list[tuple[str, int, int]]]]:
    """(text, personal spans) of written sentences."""
    rng = np.random.default_rng(seed)
    digits = lambda k: "".join(map(str, rng.integers(0, 10, k)))
    pick = lambda *x: x[int(rng.integers(len(x)))]
    word = lambda: "".join(pick(*"aeiou") + pick(*"nrstlmd") for _ in range(int(rng.integers(1, 4))))
    prose = lambda k: " ".join(word() for _ in range(k))
    checked = lambda d: next(f"{d}{c}" for c in range(10) if luhn(f"{d}{c}"))
    date = lambda: pick(f"20{digits(2)}-{digits(2)}-{digits(2)}", f"{digits(2)}/{digits(2)}/20{digits(2)}", f"{digits(2)}.{digits(2)}.20{digits(2)}")
    good = {
        "email": lambda: f"{word()}{pick('.', '_', '')}{word()}{pick(' at ', ' (at) ', '[at]', '(at)', ' [at] ', '{at}', ' AT ')}{word()}{pick(' dot ', ' (dot) ', '[dot]', '.', ' [dot] ', ' DOT ')}{pick('com', 'org', 'net', 'de')}",
        "ip": lambda: ":".join(f"{int(rng.integers(0, 65536)):x}" for _ in range(8)),
        "card": lambda: (lambda d: pick(d, " ".join(d[i : i + 4] for i in range(0, 16, 4)), "-".join(d[i : i + 4] for i in range(0, 16, 4)), f"{d[:4]} {d[4:10]} {d[10:15]}"))(pick(digits(16), checked(digits(15)))),
        "phone": lambda: pick(f"({digits(3)}) {digits(3)}-{digits(4)}", f"{digits(3)}-{digits(3)}-{digits(4)}", f"{digits(3)} {digits(3)} {digits(4)}", f"{digits(3)}.{digits(3)}.{digits(4)}", f"+{digits(2)} {digits(3)} {digits(7)}"),
    }
    bad = [
        lambda: f"{pick('order', 'invoice', 'ticket', 'serial', 'tracking', 'ref', 'ISBN')} {digits(int(rng.integers(8, 20)))}",
        lambda: f"{pick('ISBN 978-', 'ISBN 979-')}{digits(1)}-{digits(3)}-{digits(5)}-{digits(1)}",
        lambda: f"{pick('on', 'date', '')} 20{digits(2)}-{digits(2)}-{digits(2)} {digits(2)}:{digits(2)}:{digits(2)}",
        lambda: f"{pick('19', '20')}{digits(2)}-{pick('19', '20')}{digits(2)}",
        lambda: f"{digits(1)},{digits(3)},{digits(3)},{digits(3)}",
        lambda: f"{digits(2)}.{digits(int(rng.integers(6, 14)))}",
        lambda: f"{pick('', '#', '$', '=')}{digits(int(rng.integers(7, 20)))}{pick('', '_x', 'ab', '%')}",
        lambda: f"{digits(int(rng.integers(17, 20)))}",
        lambda: f"{digits(int(rng.integers(7, 15)))}",
        lambda: f"pages {digits(3)}-{digits(3)}, {digits(2)}/{digits(2)}",
        lambda: " ".join(digits(int(rng.integers(1, 4))) for _ in range(int(rng.integers(4, 9)))),
        lambda: f"{word()} at {word()} dot {word()}{word()} {word()}",
        lambda: f"look at {word()}. {word()}.{word()}",
        lambda: f"{pick('met', 'dinner', 'arrived', word(), word())} at {word()}. {pick(word(), 'Es', 'De', 'Info', 'It')}",
        lambda: f"{pick('look', 'visit us', 'contact us', 'write to us', 'mail me', 'found', 'available', 'posted')} at {word()}{word()}{pick('.', ' dot ')}{pick('com', 'org', 'net', 'de')}",
        lambda: pick(" ", ", ", ",").join(digits(int(rng.integers(1, 6))) for _ in range(int(rng.integers(4, 12)))),
        lambda: " ".join(date() for _ in range(int(rng.integers(1, 4)))),
        lambda: f"{digits(2)}:{digits(2)}:{digits(2)}",
        lambda: f"{digits(1)}:{digits(2)}, {digits(1)}:{digits(2)}:{digits(2)}",
    ]
    hint = {"email": ("mail", "contact", "write to"), "ip": ("IP", "host", "from"), "card": ("card", "visa", "pay with"), "phone": ("tel.", "call", "phone")}
    out = []
    for k in range(n):
        kind = KINDS[k // 2 % 4] if k % 2 else None
        said, between = [(good[kind] if kind else pick(*bad))()], pick(", ", " ", ",", " / ", " or ")
        # a bare digit string is a card number only where the text says so
        named = kind and (rng.random() < 0.4 or kind == "card" and said[0].isdigit())
        if kind in ("card", "phone") and rng.random() < 0.5:
            said += [good[kind]() for _ in range(int(rng.integers(1, 3)))]
            said = [x for x in said if named or kind != "card" or not x.isdigit()]
        lead = f"{prose(2)} {pick(*hint[kind])} " if named else f"{prose(3)} "
        dated = kind in ("card", "phone") and rng.random() < 0.25
        text, spans = lead + (date() + pick(" ", ", ") if dated and rng.random() < 0.5 else ""), []
        for x in said:
            text += between if spans else ""
            spans.append((kind, len(text), len(text) + len(x)))
            text += x
        text += pick(" ", ", ") + date() if dated else pick("", ".", ",", "!!", "***", "%%%")
        out.append((f"{text} {prose(3)}", spans if kind else []))
    return out


def _same(one: tuple, other: tuple) -> bool:
    """Spans of one kind that share nine tenths of what both cover."""
    (k, a, b), (c, lo, hi) = one, other
    return k == c and lo < b and hi > a and min(hi, b) - max(lo, a) >= 0.9 * (max(hi, b) - min(lo, a))


def examples(written: list) -> list[tuple[str, str, int, int, int]]:
    """(text, kind, start, end, 1 if personal) candidates of the sentences."""
    return [(text, *c, int(any(_same(s, c) for s in said))) for text, said in written for c in candidates(text)]


class Detector:
    """Trees and thresholds; spans() gives base and added spans of a text."""

    def __init__(self, n: int = 3000, seed: int = 5, precision: float = PRECISION):
        written = sentences(n, seed + 1)
        train, held = examples(sentences(n, seed)), examples(written)
        table = lambda rows: (np.array([features(t, k, a, b) for t, k, a, b, _ in rows]), np.array([r[4] for r in rows], float))
        self.trees = BoostedTrees().fit(*table(train))
        x, y = table(held)
        p = self.trees.predict(x)
        self.threshold, self.recall = {}, {}
        for i, kind in enumerate(KINDS):
            own = x[:, 0] == i
            order = np.argsort(-p[own], kind="stable")
            good = np.cumsum(y[own][order])
            fine = np.flatnonzero(good / np.arange(1, len(good) + 1) >= precision)
            self.threshold[kind] = max(0.5, float(p[own][order][fine[-1]])) if len(fine) else 2.0
        # over all that was written, with or without a candidate
        got = [(s[0], any(_same(s, c) for c in every)) for t, said in written if said for every in (self.spans(t)[1],) for s in said]
        for kind in KINDS:
            hits = [hit for k, hit in got if k == kind]
            self.recall[kind] = sum(hits) / len(hits) if hits else 0.0

    def added(self, text: str, base: list) -> list[tuple[str, int, int]]:
        """Candidates that the trees accept and that touch no base span; of overlapping ones the best."""
        found = [c for c in candidates(text) if not any(a < c[2] and b > c[1] for _, a, b in base)]
        if not found:
            return []
        p = self.trees.predict(np.array([features(text, *c) for c in found]))
        out: list[tuple[str, int, int]] = []
        for k in np.argsort(-p, kind="stable"):
            kind, a, b = found[k]
            if p[k] >= self.threshold[kind] and not any(lo < b and hi > a for _, lo, hi in out):
                out.append(found[k])
        return out

    def spans(self, text: str) -> tuple[list, list]:
        base = base_spans(text)
        both = base + self.added(text, base)
        return base, sorted(both, key=lambda s: (KINDS.index(s[0]), s[1], s[2]))


def _digest(spans) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def redacted(text: str, spans) -> str:
    """The text with every span replaced by its kind in brackets; overlapping spans become one."""
    out, at = [], 0
    for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a >= at:
            out += [text[at:a], f"[{kind.upper()}]"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def find_pii(docs: DataFrame, detector: Detector | None = None, keep: list[str] | None = None) -> DataFrame:
    """Columns `keep` (default: doc_id), n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added, redacted.

    The counts and base_sha256 are of the base spans; spans has the added ones too, of the same
    four kinds. Null text is empty: no spans, redacted "". Other columns are ignored unless
    kept. Repeated rows and null ids give a row each; an empty table gives none. A text of any
    length is searched whole.
    """
    keep = keep or ["doc_id"]
    names = [f"_{i}" for i in range(len(keep))]
    kinds = ", ".join(f"{n} {docs.schema[c].dataType.simpleString()}" for n, c in zip(names, keep, strict=True))
    detector = detector or Detector()
    fields = [(f"n_{k}", pa.int64()) for k in KINDS] + [("base_sha256", pa.string()), ("spans", pa.string()), ("n_added", pa.int64()), ("redacted", pa.string())]
    found = pa.schema(fields)
    nothing = hashlib.sha256(b"").hexdigest()

    def run(batches):
        for batch in blocks(batches, "_text"):
            rows = []
            for t in batch.column("_text").to_pylist():
                base, every = detector.spans(t) if t else ((), ())
                if not every:
                    rows.append((0, 0, 0, 0, nothing, "", 0, t or ""))
                    continue
                n = [sum(k == kind for k, _, _ in base) for kind in KINDS]
                rows.append((*n, hashlib.sha256(_digest(base).encode()).hexdigest(), _digest(every), len(every) - len(base), redacted(t, every)))
            made = batch_of(found, *zip(*rows, strict=True))
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), *made.columns], names=[*names, *found.names])

    out = ", ".join(f"n_{k} long" for k in KINDS) + ", base_sha256 string, spans string, n_added long, redacted string"
    rows = docs.select(*[F.col(c).alias(n) for n, c in zip(names, keep, strict=True)], F.col("text").cast("string").alias("_text"))
    return rows.mapInArrow(run, f"{kinds}, {out}").select(*[F.col(n).alias(c) for n, c in zip(names, keep, strict=True)], *found.names)


def op3_pii(spark, sf_dir) -> DataFrame:
    """Personal data in all documents: base counts and digest, and all spans."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return find_pii(docs).drop("redacted")
