"""Secrets in texts: fixed patterns, and entropy of sliding windows over candidate strings.

Everything is built of Spark SQL functions; no Python runs on the executors.

*Base kinds* are matches of fixed patterns. *Entropy kinds* come on top: every maximal run of a
character class (``CLASSES``) is a candidate; a window of ``WINDOW`` characters slides over it,
its Shannon entropy kept up to date by the counts of the one character that leaves and the one
that enters. What the windows at or above the class's limit cover, from the first to the last,
is a span, unless an allow-list pattern (``ALLOWED``) matches the candidate or a base span
covers it already. Weights are whole numbers, so the order of additions cannot matter.

Null and empty texts have no spans; each row is worked on alone, so repeated rows, null ids and
extra columns need no care. Positions count code points.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The base patterns (letters of the key words in either case), in the order in
# which kinds of one start are listed, the least length, and the group that is measured.
BASE = (
    ("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 8, 2),
    ("access", r"AKIA[A-Z0-9]+", 16, 0),
    ("hex", r"[0-9a-f]{32,}", 32, 0),
)

#: Candidate runs, what they must hold, and the least entropy of a window in bits.
CLASSES = (
    ("entropy_hex", r"[A-Za-z0-9]{20,}", ("^[0-9A-Fa-f]+$", "[0-9]", "[A-Fa-f]"), 3.0),
    ("entropy_base64", r"[A-Za-z0-9+/_=-]{20,}", ("[0-9]", "[a-z]", "[A-Z]"), 3.6),
)
#: Candidates known to be harmless: placeholders, alphabets and digit rows, UUIDs, paths.
ALLOWED = (
    r"(?i)example|placeholder|changeme|dummy|sample",
    r"(?i)abcdefghij|qwertyuiop|0123456789|(.)\1{7}",
    r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$",
    r"^/?([a-z0-9_-]+/){2,}[a-z0-9_-]*$",
)
WINDOW = 20
KINDS = tuple(b[0] for b in BASE) + tuple(c[0] for c in CLASSES)

_SPANS = "array<struct<s:int,k:int,e:int>>"
_SCALE = 1 << 20
#: step[c]: what the c-th equal character in a window adds to the sum of c * log2(c).
_STEPS = [0] + [
    round(c * math.log2(c) * _SCALE) - (round((c - 1) * math.log2(c - 1) * _SCALE) if c > 1 else 0)
    for c in range(1, WINDOW + 1)
]

#: Matches of a text whose positions are added up at a time.
MATCHES = 128
#: Windows that are judged at a time.
BLOCK = 256
#: The character that stands for no occurrence; counts go up to WINDOW from there.
_ZERO = 64


def most_repetition(bits: float) -> int:
    """The greatest sum of c * log2(c) over a window with at least so much entropy, scaled."""
    return math.floor(WINDOW * (math.log2(WINDOW) - bits) * _SCALE)


def _quoted(text: str) -> str:
    return "r'" + text + "'" if "'" not in text else 'r"' + text + '"'


def _let(value: str, name: str, body: str) -> str:
    return f"transform(array({value}), {name} -> {body})[0]"


def _pieces(df: DataFrame, name: str, pattern: str, group: int, text: str) -> DataFrame:
    """Adds ``name``: the matches of a pattern as structs of start, end and value."""
    lit = F.lit(pattern)
    has = F.col(text).rlike(pattern)
    df = df.withColumns(
        {
            f"{name}_m": F.when(has, F.regexp_extract_all(text, lit, F.lit(0))),
            f"{name}_g": F.when(has, F.split(text, pattern, -1)),
            f"{name}_v": F.when(has, F.regexp_extract_all(text, lit, F.lit(group))) if group else F.lit(None),
        }
    )
    value = f"{name}_v" if group else f"{name}_m"
    # Positions are sums of what stands before. They are added up in blocks of matches, and those
    # moved by the sums of the blocks before: appending all to one array would cost the square.
    size = f"(length({name}_g[i - 1]) + length({name}_m[i - 1]))"
    inside = f"""aggregate(
        sequence(q * {MATCHES} + 1, least(size({name}_m), (q + 1) * {MATCHES})),
        named_struct('at', 0, 'out', cast(array() as array<struct<s:int,e:int,v:string>>)),
        (a, i) -> named_struct('at', a.at + {size}, 'out', concat(a.out, array(named_struct(
            's', a.at + length({name}_g[i - 1]), 'e', a.at + {size}, 'v', {value}[i - 1])))))"""
    blocks = f"transform(sequence(0, (size({name}_m) - 1) div {MATCHES}), q -> {inside})".replace("(q *", "(cast(q as int) *").replace("(q + 1)", "(cast(q as int) + 1)")
    before = """aggregate(x, named_struct('at', 0, 'out', cast(array() as array<int>)),
        (a, y) -> named_struct('at', a.at + y.at, 'out', concat(a.out, array(a.at))), a -> a.out)"""
    moved = "transform(y.out, z -> named_struct('s', z.s + o, 'e', z.e + o, 'v', z.v))"
    at = _let(blocks, "x", f"flatten(zip_with(x, {before}, (y, o) -> {moved}))")
    found = F.when(F.size(f"{name}_m") > 0, F.expr(at)).otherwise(F.expr("cast(array() as array<struct<s:int,e:int,v:string>>)"))
    return df.withColumn(name, found).drop(f"{name}_m", f"{name}_g", f"{name}_v")


def _windows(codes: str, begin: str, limit: int) -> str:
    """(first, last) begin of the windows over some codes that reach the entropy, -1 for none. The
    state holds how often each code is in the window, as one character per code, and the
    window's sum; a step looks up and changes the counts of two codes."""
    w = WINDOW
    step = "array(" + ",".join(f"{x}L" for x in _STEPS) + ")"
    count = lambda counts, code: f"(ascii(substring({counts}, {code} + 1, 1)) - {_ZERO})"
    put = lambda counts, code, n: f"overlay({counts}, char({_ZERO} + {n}), {code} + 1, 1)"
    leaving, coming = f"c[i - {w + 1}]", "c[i - 1]"
    went = count("a.counts", leaving)
    without = f"""if(i > {w}, named_struct('counts', {put("a.counts", leaving, went + " - 1")}, 'sum', a.sum - {step}[{went}]),
        named_struct('counts', a.counts, 'sum', a.sum))"""
    # The window that ends before i is judged at step i, when its sum is known.
    hit = f"(i > {w} and a.sum <= {limit}L)"
    after = f"""named_struct('counts', {put("b.counts", coming, "n + 1")}, 'sum', b.sum + {step}[n + 1],
        'first', if({hit} and a.first < 0, i - {w + 1}, a.first), 'last', if({hit}, i - {w + 1}, a.last))"""
    moved = _let(without, "b", _let(count("b.counts", coming), "n", after))
    last = f"(a.sum <= {limit}L)"
    return _let(codes, "c", f"""aggregate(
        sequence(1, size(c)),
        named_struct('counts', repeat(char({_ZERO}), 128), 'sum', 0L, 'first', -1, 'last', -1),
        (a, i) -> {moved},
        a -> _let_end)""").replace("_let_end", f"""named_struct(
            'first', if(a.first >= 0, {begin} + a.first, if({last}, {begin} + size(c) - {w}, -1)),
            'last', if({last}, {begin} + size(c) - {w}, if(a.last >= 0, {begin} + a.last, -1)))""")


def _window_spans(candidates: str, k: int, needed: tuple[str, ...], bits: float) -> Column:
    """Spans of high entropy inside the candidates, from the first such window to the last. The
    windows of a long candidate are taken in blocks from either end, until there is one."""
    w, limit = WINDOW, most_repetition(bits)
    block = _windows(f"slice(x.codes, f * {BLOCK} + 1, {BLOCK + w - 1})", f"f * {BLOCK}", limit)
    blocks = f"cast(ceil((size(x.codes) - {w - 1}) / {BLOCK}) as int)"
    ahead = f"aggregate(sequence(0, {blocks} - 1), named_struct('first', -1, 'last', -1), (z, f) -> if(z.first >= 0, z, {block}))"
    back = f"aggregate(sequence({blocks} - 1, 0, -1), -1, (z, f) -> if(z >= 0, z, {block}.last))"
    ends = _let(ahead, "y", f"named_struct('first', y.first, 'last', if({blocks} = 1 or y.first < 0, y.last, {back}))")
    wanted = " and ".join([f"x.v rlike {_quoted(n)}" for n in needed] + [f"not x.v rlike {_quoted(p)}" for p in ALLOWED])
    coded = "named_struct('s', x.s, 'codes', transform(split(x.v, ''), c -> ascii(c)))"
    span = _let(ends, "y", f"named_struct('s', x.s + y.first, 'k', {k}, 'e', x.s + y.last + {w}, 'any', y.first >= 0)")
    return F.expr(
        f"transform(filter(transform(transform(filter({candidates}, x -> {wanted}), x -> {coded}), x -> {span}), y -> y.any),"
        " y -> named_struct('s', y.s, 'k', y.k, 'e', y.e))"
    )


def _joined(spans: str) -> Column:
    names = "array(" + ",".join(f"'{k}'" for k in KINDS) + ")"
    return F.expr(f"concat_ws(',', transform({spans}, x -> concat({names}[x.k], ':', x.s, ':', x.e)))")


def find_secrets(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``doc_id``, ``base`` and ``spans`` (arrays of start, kind number, end, in order) per row."""
    df = docs.select(F.col(id_column).alias("doc_id"), F.coalesce(F.col(text_column).cast("string"), F.lit("")).alias("text"))
    for name, pattern, _, group in BASE:
        df = _pieces(df, name, pattern, group, "text")
    for name, pattern, _, _ in CLASSES:
        df = _pieces(df, name, pattern, 0, "text")
    kept = [
        f"transform(filter({name}, x -> length(x.v) >= {least}), x -> named_struct('s', x.s, 'k', {k}, 'e', x.e))"
        for k, (name, _, least, _) in enumerate(BASE)
    ]
    df = df.withColumn("base", F.expr(f"array_sort(concat({','.join(kept)}))"))
    extra = [_window_spans(name, len(BASE) + k, needed, bits) for k, (name, _, needed, bits) in enumerate(CLASSES)]
    df = df.select("doc_id", "base", F.concat(*extra).cast(_SPANS).alias("extra"))
    fresh = F.expr("filter(extra, x -> not exists(base, y -> y.s <= x.s and x.e <= y.e))")
    return df.select("doc_id", "base", F.array_sort(F.concat("base", fresh)).alias("spans"))


def digest(found: DataFrame) -> DataFrame:
    """Counts per base kind, a hash of the base spans, and all spans as text."""
    count = lambda k: F.expr(f"cast(size(filter(base, x -> x.k = {k})) as long)")
    return found.select(
        "doc_id",
        count(0).alias("n_assign"),
        count(1).alias("n_access"),
        count(2).alias("n_hex"),
        F.sha2(_joined("base"), 256).alias("base_sha256"),
        _joined("spans").alias("spans"),
    )
