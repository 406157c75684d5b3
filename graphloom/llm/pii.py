"""Personal data, with offset-preserving deobfuscation.

Base patterns run on the source text. Transducers then rewrite disguises and keep, for every character they emit, the
source characters it came from: homoglyphs (full-width forms, Cyrillic and Greek look-alikes, exotic digits and
separators) become ASCII, runs of spelled digits become digits, and "at" / "dot" disguises become @ and a point. The
same patterns run on the rewritten text, and what they find is mapped back to source characters. A mapped span is added
only if its source reads otherwise and it is not a base span; base spans always stay.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from array import array
from bisect import bisect_right
from collections.abc import Callable, Iterator
from io import StringIO

import pyarrow as pa
from pyspark.sql import DataFrame

from graphloom.llm.common import annotate
from graphloom.llm.decontaminate import words_of

KINDS = ("email", "ip", "card", "phone")
Span = tuple[int, int]

# Equivalents of the stated patterns that take linear time: each starts only where a leftmost match can start.
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")


def _emails(text: str) -> Iterator[Span]:
    last = at = 0
    while (at := text.find("@", at)) >= 0:
        start = at
        while start > last and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            yield start, m.end()
            last = at = m.end()
        else:
            at += 1


def _ips(text: str) -> Iterator[Span]:
    for m in _IP.finditer(text):
        if all(len(p) <= 3 and int(p or 0) <= 255 for p in (p.lstrip("0") for p in m.group().split("."))):
            yield m.span()


def _luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def _cards(text: str) -> Iterator[Span]:
    for m in _CARD.finditer(text):
        if 16 <= m.end() - m.start() and 16 <= len(digits := "".join(_DIGIT.findall(m.group()))) <= 19 and _luhn(digits):
            yield m.span()


def _phones(text: str) -> Iterator[Span]:
    for m in _PHONE.finditer(text):
        if 8 <= len(_DIGIT.findall(m.group())) <= 15:
            yield m.span()


_FINDERS: dict[str, Callable[[str], Iterator[Span]]] = {"email": _emails, "ip": _ips, "card": _cards, "phone": _phones}


_NO_DIGITS = bytes(c for c in range(256) if not 48 <= c <= 57)
#: ASCII digits that a span of each kind has at least.
_LEAST = {"email": 0, "ip": 4, "card": 16, "phone": 8}


def base(text: str, digits: int | None = None) -> dict[str, list[Span]]:
    """The spans of each kind in the text as it is, in code points; digits: how many ASCII digits it has, if known."""
    return {k: list(f(text)) if digits is None or digits >= _LEAST[k] else [] for k, f in _FINDERS.items()}


def _glyphs() -> dict[str, str]:
    """Characters that look like one ASCII letter, digit or sign, and that sign."""
    out = {}
    for c in [*range(0xFF01, 0xFF5F), *range(0x1D400, 0x1D800), *range(0x2460, 0x2474), *range(0x24B6, 0x24EA), 0xFE6B, 0xFE52, 0xFE62, 0xFE63]:
        n = unicodedata.normalize("NFKC", chr(c))
        if len(n) == 1 and n.isascii() and n.isprintable():
            out[chr(c)] = n
    for c in range(0x80, 0x110000):
        if unicodedata.category(chr(c)) == "Nd" and chr(c) not in out:
            out[chr(c)] = str(unicodedata.digit(chr(c)))
    out |= dict(zip("аеорсухіјѕԁһӏАВЕКМНОРСТХІЈЅ", "aeopcyxijsdhlABEKMHOPCTXIJS", strict=True))
    out |= dict(zip("οανικρυχΑΒΕΖΗΙΚΜΝΟΡΤΥΧ", "oavikpuxABEZHIKMNOPTYX", strict=True))
    out |= dict.fromkeys("\u2024\u3002\u30fb\u2027\u2219", ".") | dict.fromkeys("\u2010\u2011\u2012\u2013\u2014\u2212", "-")
    out |= dict.fromkeys("\xa0\u2002\u2003\u2007\u2009\u202f\u3000", " ")
    return out


_GLYPHS = _glyphs()
_GLYPH = re.compile("[" + re.escape("".join(_GLYPHS)) + "]")
_GLYPH_TABLE = {ord(c): sign for c, sign in _GLYPHS.items()}
_PART = 1 << 20
#: Bytes that lead no glyph but the no-break space.
_LOW = bytes(range(0xC6))
#: Words for the digits in four languages, without articles.
_SPELLED = {w: str(d) for d, ws in enumerate(("zero null cero", "one eins", "two zwei dos deux", "three drei tres trois", "four vier cuatro quatre", "five fünf cinco cinq", "six sechs seis", "seven sieben siete sept", "eight acht ocho huit", "nine neun nueve neuf")) for w in ws.split()}
_WORD = "|".join(sorted(_SPELLED, key=len, reverse=True))
_SPELLED_RAW = frozenset(w.encode() for w in _SPELLED)
#: Runs of at least three digits of which one is spelled; shorter runs are ordinary prose.
_DIGITS = re.compile(rf"(?i)(?<!\w)(?:{_WORD}|[0-9]++)(?:(?:, |[ ,.\-])(?:{_WORD}|[0-9]++))" + r"{2,}(?!\w)")
_DIGIT_WORD = re.compile(rf"(?i)(?<!\w)(?:{_WORD})(?!\w)")
_PLUS = re.compile(r"(?i)(?<!\w)plus (?=[0-9])")
_DOT = "(?:dot|punkt|punto|point)"
_AT = "(?:at|arobase|arroba)"
#: Last labels that make an address of a form that is also prose: "look at this point in", "@name.surname".
_TOP = "(?:com|org|net|edu|gov|info|biz|io|co|us|uk|eu|de|fr|es|it|nl|ch|at|be|ru|jp|cn|br|in|dev|app|example|test|invalid)"
_MARK = re.compile(rf"(?i) {{0,3}}[\[({{<] {{0,3}}(?:{_AT}|{_DOT}|@|\.) {{0,3}}[\])}}>] {{0,3}}")
_MARK_HINT = re.compile(rf"(?i)[\[({{<] {{0,3}}(?:{_AT}|{_DOT}|@|\.) {{0,3}}[\])}}>]")
_IS_AT = re.compile(rf"(?i){_AT}|@")
#: Any other last label, but for words that go on a sentence: "is at home dot then".
_PROSE = "then|the|and|but|or|if|that|this|these|those|there|they|we|he|she|you|when|where|which|who|what|with|from|for|of|on|not|now|also|so|und|oder|aber|dann|der|die|das|wir|sie|er|mit|nicht|auch|y|pero|entonces|el|la|los|las|con|et|ou|mais|puis|le|les|avec"
_ANY = f"(?!(?:{_PROSE})(?![a-z0-9-]))(?:[a-z]{{2,63}}|xn--[a-z0-9-]{{1,59}})"


def _form(at: str, dot: str, end: str) -> str:
    """At, label dot label ... and the end, of which any dot may already be a sign."""
    return rf"{at}[a-z0-9-]{{1,63}}+(?:(?:\.| {{1,3}}{dot} {{1,3}})[a-z0-9-]{{1,63}}+){{0,8}}{end}(?![a-z0-9-])"


def _word(*forms: str) -> str:
    return rf" {{1,3}}(?:{'|'.join(forms)}) {{1,3}}"


_SEP = rf"(?:\.|{_word(_DOT)})"
#: name at label dot label ... dot top. Any top goes with a real @ and with an at and a dot in words of one language.
_REAL = "(?:@| {1,3}@ {1,3}|@ {1,3})"
_FORMS = tuple(re.compile(f"(?i){f}") for f in (
    _form(_REAL, "dot", rf"(?:\.|{_word('dot')}){_ANY}"),
    rf"(?:{_REAL}| {{1,3}}@)[a-z0-9-]{{1,63}}+(?:{_word(_DOT)}[a-z0-9-]{{1,63}}+){{0,8}}{_word(_DOT)}{_ANY}(?![a-z0-9-])",
    _form(_word("at"), "(?:dot|punkt)", rf"(?:\.|{_word('dot', 'punkt')}){_ANY}"),
    _form(_word("arobase"), "(?:dot|point)", rf"(?:\.|{_word('dot', 'point')}){_ANY}"),
    _form(_word("arroba"), "(?:dot|punto)", rf"(?:\.|{_word('dot', 'punto')}){_ANY}"),
    _form(rf"(?:{_word(_AT)}|{_REAL}| {{1,3}}@)", _DOT, _SEP + _TOP),
))
_BARE = re.compile(rf"(?i)(?<=[a-z0-9_%+-])(?=@| {{1,3}}(?:{_AT}|@))")
_BARE_AT = re.compile(rf"(?i)^(?: *@ *| +{_AT} +)")
_BARE_DOT = re.compile(rf"(?i) +{_DOT} +")
_DOT_HINT = re.compile(rf"(?i) {_DOT} ")
#: Labels of a local part up to an at; before an at that is no disguise, only the word dot joins them.
_LABEL = "[a-z0-9._%+-]{1,64}+"
_LOCAL_DOTS, _LOCAL_DOTS_PLAIN = (re.compile(rf"(?i)(?<![a-z0-9._%+-]){_LABEL}(?:(?<=[a-z0-9_%+-]) {{1,3}}{d} {{1,3}}{_LABEL}){{1,8}}$") for d in (_DOT, "dot"))
_LOCAL_REACH = 700
#: Four numbers of an address, in figures or spelled digit by digit, with a dot in words.
_NUMBER = rf"(?:[0-9]{{1,3}}+|(?:{_WORD})(?:[ -](?:{_WORD})){{0,2}})"
_QUAD = re.compile(rf"(?i)(?<![\w.]){_NUMBER}(?:(?:\.| {{1,3}}{_DOT} {{1,3}}){_NUMBER}){{3}}(?!\w)")
_QUAD_PART = re.compile(rf"(?i) +{_DOT} +|{_WORD}|[ -]")


class Mapped:
    """A rewritten text as pieces, each with its place in the text and the source span it stands for.

    A piece that was copied stands for as many source characters as it has; a piece that was put in, for its whole span.
    """

    def __init__(self, text: str):
        self.text = text
        self.at, self.first, self.end = array("l", [0]), array("l", [0]), array("l", [-1])  # end -1: copied

    def start(self, place: int) -> int:
        """Where the source of the character at a place begins."""
        k = bisect_right(self.at, place) - 1
        return self.first[k] + (place - self.at[k] if self.end[k] < 0 else 0)

    def stop(self, place: int) -> int:
        """Where the source of the character at a place ends."""
        k = bisect_right(self.at, place) - 1
        return self.first[k] + place - self.at[k] + 1 if self.end[k] < 0 else self.end[k]

    def rewrite(self, edits: Iterator[tuple[int, int, str]]) -> bool:
        """Replaces the ordered, disjoint parts; each new character stands for the whole part. False if there are none."""
        edit = next(edits, None)
        if edit is None:
            return False
        out, size, done, k = StringIO(), 0, 0, 0
        at, first, end = array("l"), array("l"), array("l")

        def copied(upto: int) -> None:
            nonlocal size, done, k
            while done < upto:
                while k + 1 < len(self.at) and self.at[k + 1] <= done:
                    k += 1
                stop = min(upto, self.at[k + 1] if k + 1 < len(self.at) else upto)
                at.append(size)
                first.append(self.first[k] + (done - self.at[k] if self.end[k] < 0 else 0))
                end.append(self.end[k])
                out.write(self.text[done:stop])
                size += stop - done
                done = stop

        while edit is not None:
            a, b, new = edit
            copied(a)
            for c in new:
                at.append(size)
                first.append(self.start(a))
                end.append(self.stop(b - 1))
                out.write(c)
                size += 1
            done = b
            edit = next(edits, None)
        copied(len(self.text))
        self.text, self.at, self.first, self.end = out.getvalue(), at, first, end
        return True


def _has_spelled(raw: bytes) -> bool:
    """Whether a word of the text is a spelled digit; looked at in parts, so that the words of a long text do not pile up."""
    at = 0
    while at < len(raw):
        end = raw.find(b" ", at + _PART)
        end = len(raw) if end < 0 else end
        if not _SPELLED_RAW.isdisjoint(words_of(raw[at:end])):
            return True
        at = end
    return False


def _spelled(text: str) -> Iterator[tuple[int, int, str]]:
    for run in _DIGITS.finditer(text):
        if not _DIGIT_WORD.search(run.group()):
            continue
        at = run.start()
        for part in re.finditer(r"\w+|[^\w]+", run.group()):
            a, b, s = at + part.start(), at + part.end(), part.group()
            if s.lower() in _SPELLED:
                yield a, b, _SPELLED[s.lower()]
            elif not s[0].isalnum() and "." not in s:
                yield a, b, ""  # between digits of one number


def _bare(text: str) -> Iterator[tuple[int, int, str]]:
    """Disguises in words: a bare at counts only with a bare dot, so that "look at example.com" is left alone."""
    last = 0
    for start in _BARE.finditer(text):
        fits = [m for f in _FORMS if start.start() >= last and (m := f.match(text, start.start()))]
        if not fits:
            continue
        m = max(fits, key=re.Match.end)
        at, dots = _BARE_AT.match(m.group()), list(_BARE_DOT.finditer(m.group()))
        if "@" not in at.group() and not dots:
            continue
        before = (_LOCAL_DOTS_PLAIN if at.group() == "@" and not dots else _LOCAL_DOTS).search(text, max(last, m.start() - _LOCAL_REACH), m.start())
        if before:
            for d in _BARE_DOT.finditer(before.group()):
                yield before.start() + d.start(), before.start() + d.end(), "."
        last = m.end()
        if at.group() != "@":
            yield m.start(), m.start() + at.end(), "@"
        for d in dots:
            if d.start() >= at.end():
                yield m.start() + d.start(), m.start() + d.end(), "."


def _quads(text: str) -> Iterator[tuple[int, int, str]]:
    """Addresses of four numbers with a dot in words."""
    for m in _QUAD.finditer(text):
        if _BARE_DOT.search(m.group()):
            for part in _QUAD_PART.finditer(m.group()):
                s = part.group().lower()
                yield m.start() + part.start(), m.start() + part.end(), _SPELLED.get(s, "." if s.strip(" -") else "")


def deobfuscate(text: str, raw: bytes, digits: int) -> Mapped | None:
    """The rewritten text, or None if nothing in it looks disguised."""
    mapped, changed = Mapped(text), False

    def rewrite(edits: Iterator[tuple[int, int, str]]) -> None:
        nonlocal changed
        changed |= mapped.rewrite(edits)

    if not text.isascii() and (raw.translate(None, _LOW) or b"\xc2\xa0" in raw) and _GLYPH.search(text):
        mapped.text, changed = text.translate(_GLYPH_TABLE), True  # one character for one, so all places stay
    if _has_spelled(mapped.text.encode("utf-8", "replace") if changed else raw):
        rewrite(_spelled(mapped.text))
    if (digits or changed) and ("plus " in mapped.text or "Plus " in mapped.text or "PLUS " in mapped.text):
        rewrite((m.start(), m.end(), "+") for m in _PLUS.finditer(mapped.text))
    if any(c in mapped.text for c in "[({<") and _MARK_HINT.search(mapped.text):
        rewrite((m.start(), m.end(), "@" if _IS_AT.search(m.group()) else ".") for m in _MARK.finditer(mapped.text))
    if dotted := _DOT_HINT.search(mapped.text):
        rewrite(_quads(mapped.text))
    if dotted or "@" in mapped.text:
        rewrite(_bare(mapped.text))
    return mapped if changed else None


def added(text: str, raw: bytes, digits: int, plain: dict[str, list[Span]]) -> dict[str, list[Span]]:
    """Spans, in source characters, that only the rewritten text shows: their source reads otherwise."""
    mapped = deobfuscate(text, raw, digits)
    out: dict[str, list[Span]] = {k: [] for k in KINDS}
    if mapped is not None:
        for kind, find_in in _FINDERS.items():
            known = set(plain[kind])
            for a, b in find_in(mapped.text):
                s = mapped.start(a), mapped.stop(b - 1)
                if s not in known and text[s[0] : s[1]] != mapped.text[a:b]:
                    out[kind].append(s)
    return out


def _listed(spans: dict[str, list[Span]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k in KINDS for a, b in sorted(spans[k]))


def find(text: str) -> tuple[dict[str, list[Span]], dict[str, list[Span]]]:
    """Base spans and added spans of each kind."""
    raw = text.encode("utf-8", "replace")
    digits = len(raw.translate(None, _NO_DIGITS))
    plain = base(text, digits)
    return plain, added(text, raw, digits, plain)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of docs: id_col, n_email, n_ip, n_card, n_phone, base_sha256, spans.

    The counts and the hash cover base spans; `spans` lists base and added ones as kind:start:end in code points, by
    kind and start. Null and empty texts have none. Null ids and repeated rows stay as they are; other columns are
    ignored. Nothing is shuffled.
    """

    def compute(texts: list[bytes]) -> list[pa.Array]:
        counts: list[list[int]] = [[] for _ in KINDS]
        digests, spans = [], []
        for raw in texts:
            plain, more = find(raw.decode("utf-8", "replace"))
            for c, k in zip(counts, KINDS, strict=True):
                c.append(len(plain[k]))
            digests.append(hashlib.sha256(_listed(plain).encode()).hexdigest())
            spans.append(_listed({k: plain[k] + more[k] for k in KINDS}))
        return [*(pa.array(c, pa.int64()) for c in counts), pa.array(digests, pa.string()), pa.array(spans, pa.string())]

    return annotate(docs, text_col, [id_col], "n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string", lambda: compute)


def redact(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with every span, disguised ones included, replaced by its kind in angle brackets; null texts become empty."""

    def one(text: str) -> str:
        plain, more = find(text)
        out, at = [], 0
        for a, b, k in sorted((a, b, k) for s in (plain, more) for k in KINDS for a, b in s[k]):
            if a >= at:
                out += (text[at:a], f"<{k}>")
            at = max(at, b)
        return "".join([*out, text[at:]])

    names = docs.columns
    rows = annotate(docs, text_col, names, "redacted string", lambda: lambda texts: [pa.array([one(t.decode("utf-8", "replace")) for t in texts], pa.string())])
    cells = [f"c{k}" for k in range(len(names))]
    rows = rows.toDF(*cells, "redacted")
    return rows.select(*["redacted" if n == text_col else c for n, c in zip(names, cells, strict=True)]).toDF(*names)
