"""Secret scans in DataFrame operations alone: fixed patterns, and a battery of randomness tests.

Fixed patterns (leftmost, not overlapping, per kind): assign, access, hex. Beside them each run of 20 or more
characters of an encoding is a candidate. Its encoding is the smallest alphabet that holds it; where none does, its
parts between "/" and "+", between "-" and "_", and between any of the four are candidates in its place, if they have
20 or more characters. Upper-case base36 is tested as base62 too. Four tests take "characters drawn alike and independently from that
alphabet" as the null: chi-squared uniformity (Wilson-Hilferty) over its characters and over groups of them (frequent
and other letters of either case, the rest: names are short, and few letters fill them), runs about the middle of the alphabet
(Wald-Wolfowitz) and lag-1 serial correlation; their smallest p-value, times four, counts. Rejecting the null
means "not a secret". How many rejections to believe is settled by false-discovery control
(Benjamini-Hochberg) inside each stratum of encoding and length, since the power of the tests grows with
the length; what stays unrejected is a span of kind `random`, unless it overlaps a fixed one.
The p-values are counted in a histogram of bounded size, so no global sort is needed, and the only
thing that reaches the driver is one threshold for each stratum (four of each encoding).

Defined cases: null text is the empty text, with no span; null or repeated ids are kept, one row each; an
empty table gives an empty result. Positions are code points, ends exclusive. Extra columns are ignored. Time is linear in
the text, its longest run and its matches (but for a factor that grows like their logarithm where they are sorted).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granary.llm.common import scratch

#: Kinds in their order, pattern and least length (of group 2 for assign).
KINDS = ("assign", "access", "hex", "random")
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}+"
CANDIDATE = r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}+"
ASSIGN_LEAST = 6
#: Encodings; the smallest that holds a candidate is the one that counts.
ALPHABETS = (
    ("hex", "0123456789abcdef"),
    ("hexu", "0123456789ABCDEF"),
    ("base32", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"),
    ("base62", "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"),
    ("base64", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"),
    ("base64url", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_"),
    ("digits", "0123456789"),
    ("base32lower", "abcdefghijklmnopqrstuvwxyz234567"),
    ("base36lower", "0123456789abcdefghijklmnopqrstuvwxyz"),
)
#: Upper-case base36 is also base62 of few letters: such candidates are tested for both, and one that stands is enough.
ALSO = (
    ("base36", "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"),
)
#: Least length of a candidate and of a part of one.
LEAST = 20
LENGTH_STEPS = (28, 40, 64)
#: False-discovery rate of "not a secret"; steps of the p-value histogram for each power of ten, and its size.
RATE, STEPS, BINS = 0.01, 20, 240

#: Groups of the second chi-squared test; every other character of an alphabet is in one more group. Then the most that is
#: collected by appending to one array, and characters in one piece of a text that is masked.
GROUPS = ("etaoinsrhl", "bcdfgjkmpquvwxyz", "ETAOINSRHL", "BCDFGJKMPQUVWXYZ")
RUN, PIECE = 64, 4096

_PLACE = "struct<start:int,end:int>"
_SPAN = "struct<start:int,end:int,token:string>"
_NONE = f"cast(array() as array<{_SPAN}>)"


def _let(value: str, name: str, body: str) -> str:
    """SQL: body, where `name` is the value, computed once."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def _running(items: str, made: str, zero: str, after: str, out: str) -> str:
    """SQL: what `out` makes (of SQL type `made`) of every item x and the state s before it; the state is `zero` first and `after` next.
    Appending copies an array, so that is done for RUN items at a time. items: a column or lambda variable."""
    step = f"x -> named_struct('s', {after}, 'out', array_append(i.out, {out}))".replace("x ->", "(i, x) ->", 1)
    inner = (
        f"aggregate(slice({items}, b * {RUN} + 1, {RUN}), named_struct('s', o.s, 'out', cast(array() as array<{made}>)), {step})"
    )
    return (
        f"aggregate(sequence(0, cast((size({items}) - 1) div {RUN} as int)), named_struct('s', {zero}, 'out', cast(array() as array<array<{made}>>)), "
        f"(o, b) -> aggregate(array({inner}), o, (p, r) -> named_struct('s', r.s, 'out', array_append(p.out, r.out))), o -> flatten(o.out))"
    )


def _spans() -> Column:
    """Matches `m_` with their places: texts between matches and matches, in turn, add up to the position."""
    # bound by a lambda: as a column it could be put in the place of its name, and be computed for every match
    items = _let("gaps", "cuts", "transform(m_, (m, k) -> named_struct('gap', length(cuts[k]), 'size', length(m), 'token', m))")
    place = "named_struct('start', i.s + x.gap, 'end', i.s + x.gap + x.size, 'token', x.token)"
    return F.expr(_let(items, "found", _running("found", _SPAN, "0", "i.s + x.gap + x.size", place)))


def _once(items: str) -> str:
    """SQL: the items, sorted, each of them once."""
    return _let(f"sort_array({items})", "listed", "filter(listed, (x, k) -> k = 0 OR x <> listed[greatest(k - 1, 0)])")


def _find(docs: DataFrame, kind: str, pattern: str, guard: Column) -> DataFrame:
    """Add column `kind`: the spans of the pattern; the text is split only where it matches."""
    found = docs.withColumn("m_", F.when(guard, F.regexp_extract_all("text", F.lit(pattern), F.lit(0))))
    found = found.withColumn("gaps", F.when(F.size("m_") > 0, F.split("text", pattern, -1)))
    return found.withColumn(kind, F.when(F.size("m_") > 0, _spans()).otherwise(F.expr(_NONE))).drop("m_", "gaps")


def find(docs: DataFrame) -> DataFrame:
    """Adds assign, access, hex, random (candidates only, untested): arrays of start, end, token. Needs `text`."""
    out = docs.withColumn("text", F.coalesce("text", F.lit("")))
    low = F.lower("text")
    words = F.lit(False)
    for word in ("passw", "secret", "token", "api_key", "apikey"):
        words = words | low.contains(word)
    out = _find(out, "assign", ASSIGN, words)
    out = _find(out, "access", ACCESS, F.contains("text", F.lit("AKIA")))
    out = _find(out, "hex", HEX, F.lit(True))
    out = _find(out, "random", CANDIDATE, F.lit(True))
    return out.withColumn(
        "assign", F.filter("assign", lambda x: F.length(F.regexp_extract(x["token"], ASSIGN, 2)) >= ASSIGN_LEAST)
    )


def _tail(z: str) -> str:
    """Upper tail of the normal distribution at SQL expression z (a logistic fit, error below 0.0002)."""
    return f"(1 / (1 + exp(least(700D, 1.5976D * ({z}) + 0.070565992D * pow(least(30D, greatest(-30D, {z})), 3)))))"


def _parts() -> str:
    """SQL: candidates, and in place of one that no alphabet holds, its parts of LEAST or more characters."""

    def cut(at: str) -> str:
        place = "named_struct('start', i.s, 'end', i.s + length(x), 'token', x)"
        parts = _let(f"split(whole.token, '[{at}]', -1)", "pieces", _running("pieces", _SPAN, "whole.start", "i.s + length(x) + 1", place))
        return f"filter({parts}, y -> length(y.token) >= {LEAST} AND not (rlike(y.token, '[/+]') AND rlike(y.token, '[_-]')))"

    return (
        "flatten(transform(random, whole -> CASE WHEN rlike(whole.token, '[/+]') AND rlike(whole.token, '[_-]') "
        f"THEN {_once('concat(' + ', '.join(map(cut, ('/+', '_-', '/+_-'))) + ')')} ELSE array(whole) END))"
    )


def _trials() -> str:
    """SQL: candidates -> start, end, stratum, bin (of the p-value): of the smallest alphabet, and of one in ALSO if that is smaller."""
    every = ALPHABETS + ALSO

    def which(known: tuple) -> str:
        cases = " ".join(
            f"WHEN not rlike(x.token, '[^{alphabet.replace('-', '')}{'-' if '-' in alphabet else ''}]') THEN {every.index((name, alphabet))}"
            for name, alphabet in sorted(known, key=lambda x: len(x[1]))
        )
        return f"CASE {cases} END"

    listed = lambda values: "array(" + ", ".join(values) + ")"
    alphabets = listed(f"'{a}'" for _, a in every)
    # of each alphabet, the size of each group (the other characters last)
    sizes = [[sum(c in g for c in a) for g in GROUPS] for _, a in every]
    sizes = [[*s, len(a) - sum(s)] for s, (_, a) in zip(sizes, every, strict=True)]
    held = [f"cast(length(x.token) - length(translate(x.token, '{g}', '')) as double)" for g in GROUPS]
    held.append(f"cast(length(translate(x.token, '{''.join(GROUPS)}', '')) as double)")
    groups = listed(listed(f"{n}D" for n in s) for s in sizes)
    kinds = f"transform(array({which(every)}), y -> IF(y < {len(ALPHABETS)}, array(y), array({which(ALPHABETS)}, y)))[0]"
    a = f"flatten(transform({_parts()}, x -> transform({kinds}, y -> named_struct('start', x.start, 'end', x.end, 'token', x.token, 'kind', y))))"
    b = (
        f"transform({a}, x -> named_struct('start', x.start, 'end', x.end, 'kind', x.kind, 'n', cast(length(x.token) as double), "
        f"'k', cast(length({alphabets}[x.kind]) as double), "
        f"'v', transform(split(x.token, ''), c -> cast(locate(c, {alphabets}[x.kind]) - 1 as double)), "
        f"'held', {listed(held)}, 'of', {groups}[x.kind], "
        "'sq', aggregate(array_distinct(split(x.token, '')), 0D, (s, c) -> s + pow(length(x.token) - length(replace(x.token, c, '')), 2))))"
    )
    # one pass over the characters: high ones, runs, and the sums that the correlation takes
    pass_ = (
        "aggregate(t.v, named_struct('last', -1D, 'high', 0D, 'runs', 0D, 'sum', 0D, 'squares', 0D, 'products', 0D), (s, y) -> named_struct("
        "'last', y, 'high', s.high + cast(y >= t.k / 2 as double), "
        "'runs', s.runs + cast(s.last < 0 OR (y >= t.k / 2) != (s.last >= t.k / 2) as double), "
        "'sum', s.sum + y, 'squares', s.squares + y * y, 'products', s.products + IF(s.last < 0, 0D, s.last * y)))"
    )
    c = (
        f"transform({b}, t -> named_struct('start', t.start, 'end', t.end, 'kind', t.kind, 'n', t.n, 'k', t.k, 'chi', t.sq * t.k / t.n - t.n, "
        "'first', t.v[0], 'final', t.v[size(t.v) - 1], "
        "'df', cast(size(filter(t.of, g -> g > 0)) - 1 as double), "
        "'groups', aggregate(zip_with(t.held, t.of, (h, g) -> IF(g > 0, h * h * t.k / (g * t.n), 0D)), 0D, (s, y) -> s + y) - t.n, "
        f"'s', {pass_}))"
    )
    # sums of the deviations from the mean m: squares - n m m, and products - m (2 sum - first - final) + (n - 1) m m
    d = (
        f"transform({c}, t -> named_struct('start', t.start, 'end', t.end, 'kind', t.kind, 'n', t.n, "
        f"'z1', {_chi_z('t.chi', '(t.k - 1)')}, 'z4', IF(t.df < 1, -30D, {_chi_z('t.groups', 'greatest(t.df, 1D)')}), "
        "'mu', 2 * t.s.high * (t.n - t.s.high) / t.n + 1, 'runs', t.s.runs, "
        "'z3', coalesce(abs((t.s.products - t.s.sum / t.n * (2 * t.s.sum - t.first - t.final) + (t.n - 1) * pow(t.s.sum / t.n, 2)) "
        "/ nullif(greatest(t.s.squares - t.s.sum * t.s.sum / t.n, 0D), 0D) + 1 / t.n) * sqrt(t.n), 30D)))"
    )
    e = (
        f"transform({d}, t -> named_struct('start', t.start, 'end', t.end, 'kind', t.kind, 'n', t.n, 'p', least(1D, 4 * least({_tail('t.z1')}, {_tail('t.z4')}, "
        f"2 * {_tail('coalesce(abs(t.runs - t.mu) / sqrt(nullif(greatest((t.mu - 1) * (t.mu - 2) / (t.n - 1), 0D), 0D)), 30D)')}, "
        f"2 * {_tail('t.z3')}))))"
    )
    steps = " + ".join(f"cast(t.n >= {s} as int)" for s in LENGTH_STEPS)
    return (
        f"transform({e}, t -> named_struct('start', t.start, 'end', t.end, "
        f"'stratum', t.kind * {len(LENGTH_STEPS) + 1} + {steps}, "
        f"'bin', cast(least({BINS}D, floor(-log10(greatest(t.p, 1e-300D)) * {STEPS})) as int)))"
    )


def _chi_z(chi: str, df: str) -> str:
    """Normal score of a chi-squared statistic (Wilson-Hilferty)."""
    return f"(pow(greatest({chi}, 0D) / {df}, 1D / 3) - (1 - 2 / (9 * {df}))) / sqrt(2 / (9 * {df}))"


def thresholds(tested: DataFrame) -> dict[int, int]:
    """Benjamini-Hochberg per stratum, on the histogram: reject from this bin on (absent: none). A row for each stratum at most.

    A bin b holds p-values no greater than 10^(-b / STEPS); that edge is taken for all of them.
    """
    rows = (
        tested.select(F.explode("tested").alias("t"))
        .groupBy("t.stratum", "t.bin")
        .count()
        .selectExpr("stratum", "bin", "sum(count) over (partition by stratum order by bin desc) as up", "sum(count) over (partition by stratum) as m")
        .filter(F.expr(f"m * pow(10D, -bin / {STEPS}D) <= {RATE}D * up"))
        .groupBy("stratum")
        .agg(F.min("bin").alias("bin"))
        .collect()
    )
    return {r["stratum"]: r["bin"] for r in rows}


def spans(cut: dict[int, int]) -> Column:
    """kind, start, end by start, then kind as in KINDS, from the columns that `find` and `_trials` made."""
    limit = ", ".join(f"{k}, {b}" for k, b in (cut or {-1: BINS + 1}).items())
    event = "struct<start:int,rank:int,end:int>"
    listed = [f"transform({kind}, x -> named_struct('start', x.start, 'rank', {rank}, 'end', x.end))" for rank, kind in enumerate(KINDS[:3])]
    listed.append(
        f"transform(filter(tested, x -> x.bin < coalesce(element_at(map({limit}), x.stratum), {BINS + 1})), "
        "x -> named_struct('start', x.start, 'rank', 3, 'end', x.end))"
    )
    # parts may overlap, and what is tested twice stands once
    every = _once(f"concat({', '.join(listed)})")
    # a random span goes if a fixed one that starts no later (and sorts before it) ends after its start, ...
    ahead = _running("every", event, "-1", "IF(x.rank < 3, greatest(i.s, x.end), i.s)", "IF(x.rank = 3 AND i.s > x.start, named_struct('start', x.start, 'rank', 4, 'end', x.end), x)")
    # ... or one that starts later starts before its end
    back = _running("turned", event, "2147483647", "IF(x.rank < 3, x.start, i.s)", "IF(x.rank = 3 AND i.s < x.end, named_struct('start', x.start, 'rank', 4, 'end', x.end), x)")
    left = _let(every, "every", f"IF(size(every) = 0, every, reverse({_let(f'reverse({ahead})', 'turned', back)}))")
    kinds = "array(" + ", ".join(f"'{k}'" for k in KINDS) + ")"
    return F.expr(f"transform(filter({left}, x -> x.rank < 4), x -> named_struct('kind', {kinds}[x.rank], 'start', x.start, 'end', x.end))")


def _places(kind: Column | str) -> Column:
    return F.transform(kind, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end")))


def scan(docs: DataFrame) -> DataFrame:
    """The columns of `docs` but for text, and spans: array of kind, start, end by start, then kind as in KINDS (in place of a column
    of that name).

    A scratch table keeps what the regexes found, so texts are read once.
    """
    keep = [c for c in docs.columns if c not in ("text", "spans")]
    whole = docs.select(F.struct(*(F.col(c) for c in keep) if keep else [F.lit(0)]).alias("row"), "text")
    found = find(whole).select("row", *(_places(k).alias(k) for k in KINDS[:3]), F.expr(_trials()).alias("tested"))
    found = scratch(found, "secrets")
    return found.select("row", spans(thresholds(found)).alias("spans")).select(*(F.col(f"row.{c}") for c in keep), "spans")


def masked(docs: DataFrame, by: str = "[SECRET]") -> DataFrame:
    """`docs` with its secrets replaced in text (and n_chars, if there, counted anew where that happened).

    Two passes over the texts, the first for the thresholds; nothing is stored.
    """
    cut = thresholds(find(docs.select("text")).select(F.expr(_trials()).alias("tested")))
    whole = docs.select(F.struct(*docs.columns).alias("row"), "text")
    found = find(whole).withColumn("tested", F.expr(_trials())).select("row", spans(cut).alias("spans"))
    made = found.select("row", "spans", mask("row.text", "spans", by).alias("text"))
    columns = [F.col("text") if c == "text" else F.col(f"row.{c}") for c in docs.columns]
    if "n_chars" in docs.columns:
        at = docs.columns.index("n_chars")
        kind = docs.schema["n_chars"].dataType
        columns[at] = F.when(F.size("spans") > 0, F.length("text").cast(kind)).otherwise(F.col("row.n_chars")).alias("n_chars")
    return made.select(*columns)


def written(spans: Column) -> Column:
    """kind:start:end, joined by commas."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def mask(text: str, spans: str, by: str = "[SECRET]") -> Column:
    """The text with every span, or union of overlapping ones, replaced by one mark. text, spans: names of columns.

    The text is cut into pieces of PIECE characters, since every look at a place counts characters from the left.
    """
    inside = (
        f"array_join(transform(sequence(cast(g.start div {PIECE} as int), cast((g.end - 1) div {PIECE} as int)), c -> substring(pieces[c], greatest(g.start - c * {PIECE}, 0) + 1, "
        f"least(g.end, (c + 1) * {PIECE}) - greatest(g.start, c * {PIECE}))), '')"
    )
    gaps = _running("ordered", _PLACE, "0", "greatest(i.s, x.end)", "named_struct('start', i.s, 'end', x.start)")
    # a span that starts before the end of an earlier one opens no gap
    gaps = f"concat(filter({gaps}, x -> x.start <= x.end), array(named_struct('start', array_max(transform({spans}, x -> x.end)), 'end', length({text}))))"
    ordered = f"sort_array(transform({spans}, x -> named_struct('start', x.start, 'end', x.end)))"
    made = _let(f"regexp_extract_all({text}, '(?s).{{1,{PIECE}}}+', 0)", "pieces", f"transform({_let(ordered, 'ordered', gaps)}, g -> IF(g.start < g.end, {inside}, ''))")
    return F.when(F.size(spans) > 0, F.array_join(F.expr(made), by)).otherwise(F.col(text))


def digest(docs: DataFrame) -> DataFrame:
    """The contract's columns: doc_id, n_assign, n_access, n_hex, base_sha256, spans."""
    found = scan(docs.select("doc_id", "text"))
    count = lambda kind: F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("long")
    return found.select(
        "doc_id",
        *(count(k).alias(f"n_{k}") for k in KINDS[:3]),
        F.sha2(written(F.filter("spans", lambda x: x["kind"] != KINDS[3])), 256).alias("base_sha256"),
        written(F.col("spans")).alias("spans"),
    )
