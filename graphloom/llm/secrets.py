"""Secret scans with a trigram inverted index, with DataFrame functions only.

1. From the parse tree of each rule's regular expression a Boolean query over trigrams is derived: a run of characters
   demands its trigrams, alternatives are joined by OR, what is optional demands nothing. Trigrams are lower-case.
2. The index holds a posting (gram, row key) for each trigram of the queries that a text contains.
3. Postings are intersected by row key and the queries evaluated; rows that pass are a rule's candidates.
4. Candidates are verified by the expression itself. A rule that demands no trigram scans every text.

indexed() builds the index as a table, which scan() takes. Texts are never moved to their candidates: the candidates'
keys are hashed into blocks of bits, which all tasks get, and a text is verified for a rule whose bit its key finds set.
Other rows' bits can only add verifications. Without an index, scan() intersects a row's trigrams in the row, as far as
each query needs them, and no postings are made.

A row key is a hash of id and text. Rows of one key share their candidates, which can only add verifications.
Matches of every rule are found in time linear in the text: what can be repeated without end is either taken whole by
the match or preceded by a run of bounded length.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce
from itertools import product
from re import _constants as op  # the standard library's parse tree
from re import _parser as parser

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import materialize, text_of


@dataclass(frozen=True)
class Rule:
    """kind; an expression that Java, RE2 and Python read alike; a group that must have at least `least` characters."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 0


ASSIGN = "(?i:(password|passwd|secret|token|api_?key))[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
BASE = (Rule("assign", ASSIGN, 2, 12), Rule("access", "AKIA[A-Z0-9]{14,}"), Rule("hex", "[0-9a-f]{16,}"))
#: Rules that the method adds.
MORE = (
    Rule("github", "gh[oprsu]_[A-Za-z0-9]{36,}"),
    Rule("slack", "xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", "AIza[A-Za-z0-9_-]{35}"),
    Rule("stripe", "sk_live_[A-Za-z0-9]{16,}"),
    Rule("jwt", "eyJ[A-Za-z0-9_-]{8,200}\\.eyJ[A-Za-z0-9_-]{8,}\\.[A-Za-z0-9_-]{8,}"),
    Rule("private", "-----BEGIN [A-Z ]{0,30}PRIVATE KEY-----"),
)

#: A query: a trigram, ("and", queries), ("or", queries), or None, which every text meets.
Query = str | tuple | None
_WIDEST, _MOST = 8, 64


def _all(parts: list[Query]) -> Query:
    parts = list(dict.fromkeys(p for p in parts if p is not None))
    return None if not parts else parts[0] if len(parts) == 1 else ("and", tuple(parts))


def _any(parts: list[Query]) -> Query:
    if not parts or None in parts:
        return None
    parts = list(dict.fromkeys(parts))
    return parts[0] if len(parts) == 1 else ("or", tuple(parts))


def _choices(code: object, arg: object) -> str | None:
    """The lower-case characters that one node matches, if they are few."""
    if code is op.LITERAL:
        return chr(arg).lower()
    if code is op.IN:
        got = set()
        for kind, x in arg:
            if kind is op.LITERAL:
                got.add(chr(x).lower())
            elif kind is op.RANGE and x[1] - x[0] < _WIDEST:
                got |= {chr(c).lower() for c in range(x[0], x[1] + 1)}
            else:
                return None
        return "".join(sorted(got)) if len(got) <= _WIDEST else None
    return None


def _of(tree: list) -> Query:
    parts: list[Query] = []
    run: list[str] = []

    def close() -> None:
        for at in range(len(run) - 2):
            grams = ["".join(g) for g in product(*run[at : at + 3])]
            if len(grams) <= _MOST:
                parts.append(_any(grams))
        run.clear()

    for code, arg in tree:
        if (c := _choices(code, arg)) is not None:
            run.append(c)
            continue
        if code in (op.MAX_REPEAT, op.MIN_REPEAT, op.POSSESSIVE_REPEAT):
            least, most, body = arg
            if len(body) == 1 and (c := _choices(*body[0])) is not None and least:
                run.extend([c] * min(least, 3))
                if least == most and least <= 3:
                    continue
            close()
            if least:
                parts.append(_of(body))
        elif code is op.SUBPATTERN:
            close()
            parts.append(_of(arg[-1]))
        elif code is op.BRANCH:
            close()
            parts.append(_any([_of(b) for b in arg[1]]))
        else:
            close()
    close()
    return _all(parts)


def query(pattern: str) -> Query:
    """The Boolean trigram query that every match of the expression meets."""
    return _of(list(parser.parse(pattern)))


def grams(q: Query) -> set[str]:
    return set() if q is None else {q} if isinstance(q, str) else set().union(*(grams(p) for p in q[1]))


def row_key(id_col: str, text_col: str) -> Column:
    return F.xxhash64(F.col(id_col), text_of(text_col))


def postings(docs: DataFrame, vocabulary: list[str], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(gram int, key long): the numbers of the vocabulary's trigrams that each text contains in lower case."""
    rows = docs.select(row_key(id_col, text_col).alias("key"), F.lower(text_of(text_col)).alias("low"))
    numbered = F.array(*[F.struct(F.lit(k).alias("n"), F.lit(g).alias("g")) for k, g in enumerate(vocabulary)])
    held = F.filter(numbered, lambda g: F.contains(F.col("low"), g["g"]))
    return rows.select("key", F.explode(F.transform(held, lambda g: g["n"])).alias("gram")).select("gram", "key")


def _meets(q: Query, held: Callable[[str], Column]) -> Column:
    """Whether a query is met, by the trigrams that are held; what decides it is looked at first, and then no more."""
    if isinstance(q, str):
        return held(q)
    return reduce(lambda a, b: a & b if q[0] == "and" else a | b, [_meets(p, held) for p in q[1]])


def candidates(index: DataFrame, vocabulary: list[str], queries: list[Query]) -> DataFrame:
    """(key, rules long): the rules, as bits, whose queries the postings of a key meet."""
    words = -(-len(vocabulary) // 62)
    bits = [F.bit_or(F.when((F.col("gram") >= 62 * w) & (F.col("gram") < 62 * (w + 1)), F.expr(f"shiftleft(1L, gram - {62 * w})")).otherwise(F.lit(0).cast("long"))).alias(f"w{w}") for w in range(words)]
    place = {g: divmod(k, 62) for k, g in enumerate(vocabulary)}

    def held(gram: str) -> Column:
        w, b = place[gram]
        return F.col(f"w{w}").bitwiseAND(F.lit(1 << b)) != 0

    rules = reduce(lambda a, b: a + b, [F.when(_meets(q, held), F.lit(1 << k)).otherwise(F.lit(0)).cast("long") for k, q in enumerate(queries) if q is not None], F.lit(0).cast("long"))
    return index.groupBy("key").agg(*bits).select("key", rules.alias("rules")).where("rules > 0")


#: Bits of a block (those of bitmap_construct_agg), candidates for each block, and the most blocks: 8 MB of bits.
_BITS, _EACH, _BLOCKS = 32768, 128, 2048


def _bit(k: Column) -> Column:
    """The place in its block of a key's bit for rule k."""
    return F.pmod(F.xxhash64("key", k), F.lit(_BITS))


def _marked(rows: DataFrame, index: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """rows with a column `marks`: bits that are set for every rule, by number, of which the row's key is a candidate.

    Postings are intersected and the candidates written at once; what reads the result needs the index no more. A bit is
    also set where keys of one block collide. The blocks grow with the candidates up to their most; past that more bits
    collide, and more texts are verified.
    """
    queries = [query(r.pattern) for r in rules]
    hits = materialize(candidates(index, vocabulary_of(rules), queries), "candidates")
    blocks = min(max(-(-hits.count() // _EACH), 1), _BLOCKS)
    block = F.pmod("key", F.lit(blocks)).alias("block")
    each = F.explode(F.filter(F.array(*[F.lit(k) for k in range(len(rules))]), lambda k: F.getbit("rules", k) == 1)).alias("k")
    bits = hits.select("key", "rules", block).repartition("block").select("key", "block", each).groupBy("block").agg(F.bitmap_construct_agg(_bit(F.col("k"))).alias("bits"))
    near = rows.select("*", block).join(F.broadcast(bits), "block", "left")

    def mark(k: int) -> Column:
        byte = F.conv(F.hex(F.substring("bits", (F.floor(_bit(F.lit(k)) / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("long")
        return F.shiftleft(F.getbit(byte, (_bit(F.lit(k)) % 8).cast("int")).cast("long"), k)

    marks = reduce(lambda a, b: a.bitwiseOR(b), [mark(k) for k in range(len(rules))])
    return near.select(*rows.columns, F.when(F.col("bits").isNull(), F.lit(0).cast("long")).otherwise(marks).alias("marks"))


_CHUNK = 64


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with the value computed once however often the body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _total(rows: Column) -> Column:
    return F.aggregate(rows, F.lit(0).cast("long"), lambda a, x: a + x["gap"] + x["len"])


def _located(rows: Column, n: int) -> Column:
    """rows of (gap before a match, length, match) as (start, n, end, match).

    A match starts after all gaps and matches before it. The sums are taken over chunks first, so that many matches in
    one text stay cheap.
    """
    last = F.floor((F.size(rows) - 1) / _CHUNK).cast("int")
    sums = F.transform(F.sequence(F.lit(0), last), lambda c: _total(F.slice(rows, c * _CHUNK + 1, _CHUNK)))

    def place(before: Column) -> Column:
        def one(x: Column, k: Column) -> Column:
            inside = F.slice(rows, (k - k % _CHUNK + 1).cast("int"), (k % _CHUNK).cast("int"))
            start = F.get(before, F.floor(k / _CHUNK).cast("int")) + _total(inside) + x["gap"]
            return _let(start, lambda s: F.struct(s.alias("start"), F.lit(n).alias("n"), (s + x["len"]).alias("end"), x["m"].alias("m")))

        return F.transform(rows, one)

    add = lambda a, x: a + x
    upto = lambda sums: F.transform(sums, lambda _, c: F.aggregate(F.slice(sums, F.lit(1), c), F.lit(0).cast("long"), add))
    return _let(sums, lambda each: _let(upto(each), place))


def _spans(rule: Rule, n: int) -> Column:
    """array<struct<start, n, end>> of a text's matches, leftmost and not overlapping, in code points.

    The text is split at the matches; gaps and matches in turn give the places.
    """
    text, pattern = F.col("text"), F.lit(rule.pattern)
    found = F.regexp_extract_all(text, pattern, F.lit(0))
    gap = lambda pieces, k: F.length(F.get(pieces, k)).cast("long").alias("gap")
    each = _let(F.split(text, rule.pattern, -1), lambda pieces: F.transform(found, lambda m, k: F.struct(gap(pieces, k), F.length(m).cast("long").alias("len"), m.alias("m"))))
    spans = _let(each, lambda rows: _located(rows, n))
    if rule.least:
        spans = F.filter(spans, lambda s: F.length(F.regexp_extract(s["m"], rule.pattern, rule.group)) >= rule.least)
    plain = F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["n"].alias("n"), s["end"].alias("end")))
    return F.when(F.col("text").rlike(rule.pattern), plain).otherwise(F.array().cast("array<struct<start:bigint,n:int,end:bigint>>"))


def _listed(spans: Column, rules: tuple[Rule, ...]) -> Column:
    kind = F.array(*[F.lit(r.kind) for r in rules])
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", F.get(kind, s["n"]), s["start"], s["end"])), ",")


def vocabulary_of(rules: tuple[Rule, ...]) -> list[str]:
    """The trigrams that the rules' queries ask for, in order."""
    return sorted(set().union(*(grams(query(r.pattern)) for r in rules)))


def indexed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = BASE + MORE) -> DataFrame:
    """The inverted index of docs for scan(): the postings of the rules' vocabulary, written as a table."""
    return materialize(postings(docs, vocabulary_of(rules), id_col, text_col), "postings")


def _found(docs: DataFrame, keep: dict[str, Column], id_col: str, text_col: str, rules: tuple[Rule, ...], index: DataFrame | None) -> DataFrame:
    """The columns keep, and an array of spans of each rule as s0, s1, ..."""
    queries = [query(r.pattern) for r in rules]
    rows = docs.select(*[c.alias(n) for n, c in keep.items()], text_of(text_col).alias("text"), *([] if index is None else [row_key(id_col, text_col).alias("key")]))
    none = F.array().cast("array<struct<start:bigint,n:int,end:bigint>>")
    if index is None:
        low = rows.withColumn("low", F.lower("text"))
        tests = [F.lit(True) if q is None else _meets(q, lambda g: F.contains(F.col("low"), F.lit(g))) for q in queries]
        rows = low.select(*keep, "text", *[t.alias(f"q{k}") for k, t in enumerate(tests)])
    elif any(q is not None for q in queries):
        rows = _marked(rows, index, rules)
    spans = []
    for k, (rule, q) in enumerate(zip(rules, queries, strict=True)):
        s = _spans(rule, k)
        may = F.lit(True) if q is None else F.col(f"q{k}") if index is None else F.getbit("marks", F.lit(k)) == 1
        spans.append(F.when(may, s).otherwise(none).alias(f"s{k}"))
    return rows.select(*keep, *spans)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = BASE + MORE, index: DataFrame | None = None) -> DataFrame:
    """One row for each row of docs: id_col, n_assign, n_access, n_hex, base_sha256, spans.

    The counts and the hash cover the base rules; `spans` lists all rules' spans as kind:start:end in code points, by
    start and then kind as listed. Null and empty texts have none. Null ids and repeated rows stay as they are; other
    columns are ignored. rules begins with BASE. index: postings of these rules' vocabulary, as indexed() makes them, if
    any; they are read at once and not again.
    """
    found = _found(docs, {"id": F.col(id_col)}, id_col, text_col, rules, index)
    base = F.concat(*[F.col(f"s{k}") for k in range(len(BASE))])
    return found.select(
        F.col("id").alias(id_col),
        *[F.size(f"s{k}").cast("long").alias(f"n_{r.kind}") for k, r in enumerate(BASE)],
        F.sha2(_listed(base, rules), 256).alias("base_sha256"),
        _listed(F.concat(*[F.col(f"s{k}") for k in range(len(rules))]), rules).alias("spans"),
    )


def _oracle() -> str:
    rules = BASE + MORE
    parts = []
    for n, r in enumerate(rules):
        p = r.pattern.replace("'", "''")
        fits = f"WHERE length(regexp_extract(m, '{p}', {r.group})) >= {r.least}" if r.least else ""
        parts.append(
            f"SELECT r, {n} AS n, '{r.kind}' AS kind, upto - length(m) AS a, upto AS b FROM (SELECT r, m, sum(length(gap) + length(m)) OVER (PARTITION BY r ORDER BY k) AS upto FROM "
            f"(SELECT r, unnest(found) AS m, unnest(gaps[1:len(found)]) AS gap, unnest(generate_series(1, len(found))) AS k FROM "
            f"(SELECT r, regexp_extract_all(t, '{p}') AS found, string_split_regex(t, '{p}') AS gaps FROM docs))) {fits}"
        )
    return f"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
spans AS ({" UNION ALL ".join(parts)}),
by_doc AS (
  SELECT r, count(*) FILTER (n = 0) AS n0, count(*) FILTER (n = 1) AS n1, count(*) FILTER (n = 2) AS n2,
    string_agg(kind || ':' || a || ':' || b, ',' ORDER BY a, n, b) FILTER (n < 3) AS base, string_agg(kind || ':' || a || ':' || b, ',' ORDER BY a, n, b) AS list
  FROM (SELECT r, n, kind, CAST(a AS BIGINT) AS a, CAST(b AS BIGINT) AS b FROM spans) GROUP BY r
)
SELECT doc_id, CAST(coalesce(n0, 0) AS BIGINT) AS n_assign, CAST(coalesce(n1, 0) AS BIGINT) AS n_access, CAST(coalesce(n2, 0) AS BIGINT) AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(list, '') AS spans
FROM docs LEFT JOIN by_doc USING (r)
"""


ORACLE = _oracle()
