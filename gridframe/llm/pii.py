"""PII: spans of personal data, by patterns and by boosted trees over candidates.

Base spans come from four patterns and their checks (address parts, Luhn
digits, digit counts).  Wider generators propose overlapping candidates of
the same kinds; each is described by a few small integers (its format, and the
words before it), and gradient-boosted trees tell the candidates that are
like base spans from those that are not.  As the features are discrete, the
trees are fitted exactly on the counts per feature vector over all documents,
a table of all feature vectors (some 48,000 at most).  A kind's threshold is the least score
whose candidates in the held-out half reach ``PRECISION``; candidates
above it that touch no base span are added.

All of it is DataFrame functions.  Positions are code points, end exclusive;
null texts count as empty.  Patterns are written so that each reads a text in
one pass, however long its runs."""

from __future__ import annotations

import math
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KINDS = ["email", "ip", "card", "phone"]
_LOCAL = "[A-Za-z0-9._%+-]"
# fixed values: the base patterns, in a form without backtracking; \G is the end of the match before
BASE = {
    "email": rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
WIDE = {
    "email": r"(?:\G|(?<![^\s@<>,;:]))[^\s@<>,;:]++(?:@|\x20?\(at\)\x20?)[^\s@<>,;:]++",
    "ip": r"(?<![0-9.])[0-9]++(?:\.[0-9]++){2,}+",
    "number": r"(?<![0-9A-Za-z])[+(]?[0-9](?:[\x20().-]{0,2}[0-9]){6,}+",
}
# fixed values: words before a span that speak for a kind
HINTS = {"email": "mail|contact|write to", "ip": r"\bip\b|host|server|addr", "card": "card|visa|amex|credit", "phone": "tel|phone|call|fax|mobile"}
AGAINST = r"version|license|licence|token|key|id|isbn"
CONTEXT = 24
ROUNDS, DEPTH, RATE = 20, 2, 0.4
PRECISION = 0.98
_MARK = ""  # in no pattern; a text's own are read as another such sign
_BLOCK = 256


def _in(text: Column, kind: str) -> Column:
    """A quick test that a pattern can match at all."""
    return {"email": text.contains("@") | text.contains("(at)"), "ip": text.rlike(r"[0-9]\.[0-9]"), "card": text.rlike(r"[0-9][\x20-]?[0-9]"),
            "phone": text.contains("+"), "number": text.rlike(r"[0-9][\x20().-]{0,2}[0-9]")}[kind]


def _pieces(text: Column, pattern: str) -> Column:
    """The text cut at matches: the odd pieces (from 0) are the matches."""
    clean = F.translate(text, _MARK, "\x01")
    return F.split(F.regexp_replace(clean, pattern, f"{_MARK}$0{_MARK}"), _MARK)


def _starts(lengths: Column) -> Column:
    """Running sums before each element, in blocks: an array is only ever built block by block."""
    def runs(values: Column, first: Column) -> Column:
        zero = F.struct(first.cast("int").alias("t"), F.array().cast("array<int>").alias("o"))
        return F.aggregate(values, zero, lambda acc, x: F.struct((acc["t"] + x).alias("t"), F.concat(acc["o"], F.array(acc["t"])).alias("o")))["o"]

    blocks = F.sequence(F.lit(0), F.floor((F.size(lengths) - 1) / _BLOCK).cast("int"))
    sums = F.transform(blocks, lambda b: F.aggregate(F.slice(lengths, b * _BLOCK + 1, _BLOCK), F.lit(0), lambda acc, x: acc + x))
    offsets = runs(sums, F.lit(0))
    return F.flatten(F.transform(blocks, lambda b: runs(F.slice(lengths, b * _BLOCK + 1, _BLOCK), F.get(offsets, b))))


_NONE = "array<struct<s:int,e:int,t:string>>"


def _matches(df: DataFrame, text_col: str, pattern: str, test: Column, out: str) -> DataFrame:
    """``df`` with an array of (s, e, t) of all leftmost matches that do not overlap."""
    pieces, lengths, starts = f"{out}__p", f"{out}__l", f"{out}__s"
    df = df.withColumn(pieces, F.when(test, _pieces(F.col(text_col), pattern)))
    df = df.withColumn(lengths, F.when(F.size(pieces) > 1, F.transform(pieces, lambda x: F.length(x))))
    df = df.withColumn(starts, F.when(F.col(lengths).isNotNull(), _starts(F.col(lengths))))
    spans = F.transform(F.sequence(F.lit(1), F.size(lengths) - 2, F.lit(2)), lambda i: F.struct(
        F.get(starts, i).alias("s"), (F.get(starts, i) + F.get(lengths, i)).alias("e"), F.get(pieces, i).alias("t")))
    found = F.when(F.col(starts).isNotNull(), spans).otherwise(F.array().cast(_NONE)).cast(_NONE)
    return df.withColumn(out, found).drop(pieces, lengths, starts)


def _digits(t: Column) -> Column:
    return F.regexp_replace(t, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    n = F.length(digits)
    def share(i: Column) -> Column:
        d = F.substring(digits, n - i + 1, F.lit(1)).cast("int") * F.when(i % 2 == 0, 2).otherwise(1)
        return d - F.when(d > 9, 9).otherwise(0)
    return F.aggregate(F.transform(F.sequence(F.lit(1), n), share), F.lit(0), lambda acc, x: acc + x) % 10 == 0


def _holds(kind: str, t: Column) -> Column:
    """The check of a base match."""
    if kind == "ip":
        part = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[0-9]{1,2})"
        return t.rlike(rf"^{part}(?:\.{part}){{3}}$")
    if kind == "card":
        return F.length(_digits(t)).between(16, 19) & F.when(F.length(_digits(t)).between(16, 19), _luhn(_digits(t))).otherwise(False)
    if kind == "phone":
        return F.length(_digits(t)).between(8, 15)
    return F.lit(True)


def _keeps(kind: str):
    return lambda x: _holds(kind, x["t"])


def base_spans(docs: DataFrame, text_col: str) -> DataFrame:
    """``docs`` with the arrays ``base_<kind>`` of the spans that hold."""
    for kind in KINDS:
        docs = _matches(docs, text_col, BASE[kind], _in(F.col(text_col), kind), f"base_{kind}")
        docs = docs.withColumn(f"base_{kind}", F.filter(f"base_{kind}", _keeps(kind)))
    return docs


FEATURES = ["digits", "others", "groups", "plus", "fours", "hint", "against", "tail"]


def _features(kind: Column, t: Column, before: Column) -> Column:
    """Small integers on a candidate's format and the words before it."""
    digits = F.length(_digits(t))
    hint = F.lit(0)
    for k, words in HINTS.items():
        hint = F.when((kind == k) & before.rlike(f"(?i)(?:{words})"), 1).otherwise(hint)
    flag = lambda c: F.when(c, 1).otherwise(0)
    return F.struct(
        F.when(digits < 7, 0).when(digits < 11, 1).when(digits < 13, 2).when(digits < 16, 3).when(digits < 20, 4).otherwise(5).alias("digits"),
        F.least(F.length(F.regexp_replace(t, r"[A-Za-z0-9.@\x20()+-]", "")), F.lit(2)).alias("others"),
        F.least(F.size(F.split(t, r"[^0-9]+")), F.lit(6)).alias("groups"),
        flag(t.startswith("+")).alias("plus"), flag(t.rlike(r"^[0-9]{4}(?:[ -]?[0-9]{4}){3}$")).alias("fours"),
        hint.alias("hint"), flag(before.rlike(f"(?i)(?:{AGAINST})")).alias("against"),
        F.when(t.rlike(r"\.[A-Za-z]{2,}$"), 2).when(t.rlike("[0-9]$"), 1).otherwise(0).alias("tail"))


def _proposal(kind: str, text: Column):
    def run(x: Column) -> Column:
        before = F.substring(text, F.greatest(x["s"] - CONTEXT, F.lit(0)) + 1, F.least(x["s"], F.lit(CONTEXT)))
        return F.struct(
            F.lit(kind).alias("kind"), x["s"].alias("s"), x["e"].alias("e"), _features(F.lit(kind), x["t"], before).alias("f"),
            F.exists(f"base_{kind}", lambda b: (b["s"] >= x["s"]) & (b["e"] <= x["e"])).alias("y"))
    return run


def candidates(docs: DataFrame, text_col: str) -> DataFrame:
    """``docs`` (with base spans) with an array ``proposed`` of overlapping
    candidates: kind, s, e, features and whether a base span of the kind lies in it."""
    text = F.col(text_col)
    lists = []
    for name, kinds in (("email", ["email"]), ("ip", ["ip"]), ("number", ["card", "phone"])):
        docs = _matches(docs, text_col, WIDE[name], _in(text, name), f"wide_{name}")
        for kind in kinds:
            lists.append(F.transform(f"wide_{name}", _proposal(kind, text)))
    return docs.withColumn("proposed", F.concat(*lists)).drop(*(f"wide_{n}" for n in WIDE))


class Trees:
    """Boosted trees of one kind: (feature, at most, left, right) or a leaf's value."""

    def __init__(self, trees: list, threshold: float) -> None:
        self.trees, self.threshold = trees, threshold

    def score(self, value) -> float:
        """``value(feature)``: an int here, a Column in ``column``."""
        return sum(self._walk(t, value) for t in self.trees)

    def _walk(self, tree, value) -> float:
        if not isinstance(tree, tuple):
            return tree
        feature, at, left, right = tree
        return self._walk(left if value(feature) <= at else right, value)

    def column(self, f: Column) -> Column:
        def walk(tree) -> Column:
            if not isinstance(tree, tuple):
                return F.lit(float(tree))
            feature, at, left, right = tree
            return F.when(f[feature] <= at, walk(left)).otherwise(walk(right))
        total = F.lit(0.0)
        for tree in self.trees:
            total = total + walk(tree)
        return total


def _leaf(g: float, h: float) -> float:
    return RATE * g / (h + 1.0)


def _grow(cells: list, depth: int):
    """A tree of Newton steps; a cell is (features, gradient, hessian)."""
    g, h = sum(c[1] for c in cells), sum(c[2] for c in cells)
    best = (1e-9, None)
    if depth:
        for feature in FEATURES:
            for at in sorted({c[0][feature] for c in cells})[:-1]:
                gl = sum(c[1] for c in cells if c[0][feature] <= at)
                hl = sum(c[2] for c in cells if c[0][feature] <= at)
                gain = gl * gl / (hl + 1) + (g - gl) ** 2 / (h - hl + 1) - g * g / (h + 1)
                if gain > best[0]:
                    best = (gain, (feature, at))
    if best[1] is None:
        return _leaf(g, h)
    feature, at = best[1]
    return (feature, at, _grow([c for c in cells if c[0][feature] <= at], depth - 1), _grow([c for c in cells if c[0][feature] > at], depth - 1))


def fit_trees(cells: Iterable[tuple[dict[str, int], int, int, bool]]) -> Trees | None:
    """From (features, candidates, positives, held out) cells; None without both labels."""
    cells = list(cells)
    own, aside = [c for c in cells if not c[3]], [c for c in cells if c[3]]
    n, k = sum(c[1] for c in own), sum(c[2] for c in own)
    if not 0 < k < n:
        return None
    trees = [math.log(k / (n - k))]
    score = [trees[0]] * len(own)
    for _ in range(ROUNDS):
        slopes = []
        for (f, n, k, _), s in zip(own, score):
            p = 1 / (1 + math.exp(-max(-30, min(30, s))))
            slopes.append((f, k - n * p, n * p * (1 - p)))
        tree = _grow(slopes, DEPTH)
        trees.append(tree)
        score = [s + Trees([tree], 0).score(c[0].__getitem__) for c, s in zip(own, score)]
    scored = sorted(((Trees(trees, 0).score(c[0].__getitem__), c[1], c[2]) for c in aside), reverse=True)
    threshold, n, k = math.inf, 0, 0
    for i, (s, more, good) in enumerate(scored):
        n, k = n + more, k + good
        # a tie belongs above the threshold whole
        if k >= PRECISION * n and (i + 1 == len(scored) or scored[i + 1][0] < s):
            threshold = s
    return Trees(trees, threshold)


def fit(docs: DataFrame, text_col: str = "text") -> dict[str, Trees]:
    """Trees per kind, from the candidates of all rows."""
    rows = docs.select(F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = rows.where(F.col("text").rlike("[0-9@]|\\(at\\)"))
    found = candidates(base_spans(rows, "text"), "text").select(
        F.explode_outer("proposed").alias("c"), F.pmod(F.xxhash64("text"), F.lit(2)).alias("fold")).where("c is not null")
    cells = (found.groupBy("c.kind", "c.f", "fold").agg(F.count("*").alias("n"), F.sum(F.col("c.y").cast("int")).alias("k"))
             .orderBy("kind", "f", "fold").collect())
    by_kind = {kind: fit_trees((r.f.asDict(), r.n, r.k, r.fold == 1) for r in cells if r.kind == kind) for kind in KINDS}
    return {kind: trees for kind, trees in by_kind.items() if trees}


def _named(kind: str):
    return lambda x: F.struct(F.lit(KINDS.index(kind)).alias("k"), x["s"].alias("s"), x["e"].alias("e"))


def _passes(kind: str, model: Trees, base: str):
    return lambda x: ((x["kind"] == kind) & (model.column(x["f"]) >= model.threshold)
                      & ~F.exists(base, lambda b: (b["s"] < x["e"]) & (x["s"] < b["e"])))


def with_spans(docs: DataFrame, trees: dict[str, Trees], text_col: str = "text", out: str = "pii") -> DataFrame:
    """``docs`` with ``out``: base, all, each an array of (kind, s, e) in the order of kinds, then start.

    Every row stays, repeated ones too; other columns may have any names, only one
    named ``out`` is replaced.  Null and empty texts have no span."""
    # the row goes along as one column, so that no name of it can clash
    kept = [c for c in docs.columns if c.lower() != out.lower()]
    row = F.struct(*[F.col(f"`{c}`") for c in kept]) if kept else F.lit(0)
    df = docs.select(row.alias("row"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    df = candidates(base_spans(df, "text"), "text")
    df = df.withColumn("found", F.concat(*(F.transform(f"base_{kind}", _named(kind)) for kind in KINDS)))
    parts = [F.array().cast("array<struct<k:int,s:int,e:int>>")]
    for kind, model in trees.items():
        if math.isfinite(model.threshold):
            parts.append(F.transform(F.filter("proposed", _passes(kind, model, "found")), _named(kind)))
    whole = F.array_sort(F.array_distinct(F.concat("found", "more")))
    df = df.withColumn("more", F.concat(*parts)).select("row", F.struct(F.col("found").alias("base"), whole.alias("all")).alias("spans"))
    return df.select(*[F.col("row").getField(c).alias(c) for c in kept], F.col("spans").alias(out))


def span_list(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(names, x["k"]), x["s"].cast("string"), x["e"].cast("string"))), ",")


def redacted(text: Column, spans: Column) -> Column:
    """The text with each stretch that spans cover replaced by ``[KIND]``, the
    kind being that of the span that starts it."""
    names = F.array(*(F.lit(f"[{k.upper()}]") for k in KINDS))
    ordered = F.array_sort(F.transform(spans, lambda x: F.struct(x["s"].alias("s"), (-x["e"]).alias("e"), x["k"].alias("k"))))
    start = F.struct(F.array().cast("array<string>").alias("o"), F.lit(0).alias("at"))
    step = lambda acc, x: F.when(-x["e"] <= acc["at"], acc).otherwise(F.struct(
        F.when(x["s"] < acc["at"], acc["o"]).otherwise(
            F.concat(acc["o"], F.array(F.substring(text, acc["at"] + 1, x["s"] - acc["at"]), F.get(names, x["k"])))).alias("o"),
        (-x["e"]).alias("at")))
    done = F.aggregate(ordered, start, step)
    return F.when(F.size(spans) == 0, text).otherwise(
        F.concat(F.array_join(done["o"], ""), F.substring(text, done["at"] + 1, F.length(text))))
