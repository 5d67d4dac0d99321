"""Secret scan with multipart credential linking, by SQL functions only.

Base findings stand alone (kinds assign, access, hex). Weak candidates -
40-character keys, account identifiers, service addresses - are reported only
where complementary parts co-occur: an interval join matches every part with the
scopes of the others. A scope reaches SCOPE code points beyond a part, within its
text, so the join runs inside the row: no shuffle, and a hot source is no matter.
It sweeps over the parts in order and keeps the farthest end so far; running sums
and maxima go block by block (:func:`running`), so a text of very many spans takes
time in proportion to little more than their number.

Fixed patterns of the base kinds::

    assign  (password|passwd|secret|token|api_?key)["']?\\x20*[:=]\\x20*["']?([A-Za-z0-9+/_.=-]+)   key words in either case
    access  AKIA[A-Z0-9]+      20 characters or more
    hex     [0-9a-f]+          24 characters or more
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SCOPE = 300
BLOCK = 128  # elements of a block in running aggregates
SPAN = "struct<s:int,r:int,kind:string,e:int>"
SPANS = f"array<{SPAN}>"


def either_case(words: str) -> str:
    """ASCII letters of a pattern in either case, other characters as they are."""
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in words)


ASSIGN = f"({either_case('password|passwd|secret|token|api_?key')})[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
ACCOUNT = f"({either_case('client_id|account|username|user|login')})[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9._@-]+)"
#: kind: (pattern, least length of the match or of its group, group)
KINDS = {
    "assign": (ASSIGN, 6, 2),
    "access": ("AKIA[A-Z0-9]{16,}", 20, 0),
    "hex": ("[0-9a-f]{24,}", 24, 0),
    "key40": ("[A-Za-z0-9+/]{40,}", 40, 0),  # whole runs; "=" ends one, as in name=<key>
    "account": (ACCOUNT, 3, 2),
    "address": (f"{either_case('https')}?://[^\\x20\\x09-\\x0D\"'<>]+", 10, 0),
}
BASE, WEAK = ("assign", "access", "hex"), ("key40", "account", "address")


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once, however often lambdas within ``use`` ask for it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def running(items: Column, element: str, value: Callable[[Column], Column], combine: Callable[[Column, Column], Column], zero: Column) -> Column:
    """Array of (x, before): every element and the combination of the integer values of all before it.

    Appending to an array copies it, so one fold over all elements would take
    quadratic time. Blocks are folded first, then each goes on from the fold of
    the blocks before it. ``items`` has elements of type ``element`` and is not empty.
    """

    def go_on(array: Column, kind: str, of: Callable[[Column], Column], start: Column) -> Column:
        none = F.array().cast(f"array<struct<x:{kind},before:int>>")
        step = lambda acc, x: F.struct(combine(acc["at"], of(x)).alias("at"), F.concat(acc["out"], F.array(F.struct(x.alias("x"), acc["at"].alias("before")))).alias("out"))
        return F.aggregate(array, F.struct(start.alias("at"), none.alias("out")), step, lambda acc: acc["out"])

    def by_blocks(a: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(a) - 1) / BLOCK).cast("int")), lambda j: F.slice(a, j * BLOCK + 1, F.lit(BLOCK)))
        tops = F.transform(blocks, lambda block: F.struct(block.alias("block"), F.aggregate(block, zero, lambda acc, x: combine(acc, value(x))).alias("top")))
        placed = go_on(tops, f"struct<block:array<{element}>,top:int>", lambda t: t["top"], zero)
        return F.flatten(F.transform(placed, lambda t: go_on(t["x"]["block"], element, value, t["before"])))

    return let(items, by_blocks)


def found(text: Column, kind: str) -> Column:
    """All spans of a kind, leftmost and non-overlapping: array of (s, r, kind, e), code points, end exclusive.

    The text splits at exactly the matches, so the lengths of what lies between
    and of the matches give every position.
    """
    pattern, least, group = KINDS[kind]
    rank = list(KINDS).index(kind)

    def good(m: Column) -> Column:
        if kind == "key40":
            return (F.length(m) == 40) & m.rlike("[A-Z]") & m.rlike("[a-z]") & m.rlike("[0-9]")
        return F.length(F.regexp_extract(m, pattern, group) if group else m) >= least

    pairs = F.filter(F.arrays_zip(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("m"), F.split(text, pattern, -1).alias("gap")), lambda p: p["m"].isNotNull())
    sized = F.transform(pairs, lambda p: F.struct(F.length(p["gap"]).alias("gap"), F.length(p["m"]).alias("n"), good(p["m"]).alias("ok")))
    placed = running(sized, "struct<gap:int,n:int,ok:boolean>", lambda p: p["gap"] + p["n"], lambda a, b: a + b, F.lit(0))
    kept = F.filter(placed, lambda z: z["x"]["ok"])
    spans = F.transform(kept, lambda z: F.struct((z["before"] + z["x"]["gap"]).alias("s"), F.lit(rank).alias("r"), F.lit(kind).alias("kind"), (z["before"] + z["x"]["gap"] + z["x"]["n"]).alias("e")))
    return F.when(text.rlike(pattern), spans.cast(SPANS)).otherwise(F.array().cast(SPANS))


def near(xs: Column, others: Column) -> Column:
    """Interval join: those of ``xs`` whose scope some span of ``others`` meets.

    A span o is met by x where ``o.s < x.e + SCOPE`` and ``x.s < o.e + SCOPE``: with
    both in order of o.s and x.e + SCOPE, x at equal places first, the second holds
    for some o before x exactly if it holds for the farthest end among them.
    """
    none = F.lit(-SCOPE - 1)
    event = lambda x, at, side: F.struct(at.alias("at"), F.lit(side).alias("side"), x.alias("x"))

    def sweep(p: Column) -> Column:
        events = F.array_sort(F.concat(F.transform(p["xs"], lambda x: event(x, x["e"] + SCOPE, 0)), F.transform(p["others"], lambda o: event(o, o["s"], 1))))
        swept = running(events, f"struct<at:int,side:int,x:{SPAN}>", lambda v: F.when(v["side"] == 1, v["x"]["e"]).otherwise(none), F.greatest, none)
        met = F.filter(swept, lambda z: (z["x"]["side"] == 0) & (z["x"]["x"]["s"] < z["before"] + SCOPE))
        return F.when((F.size(p["xs"]) > 0) & (F.size(p["others"]) > 0), F.transform(met, lambda z: z["x"]["x"])).otherwise(F.array().cast(SPANS))

    return let(F.struct(xs.alias("xs"), others.alias("others")), sweep)


def shown(spans: Column) -> Column:
    return F.concat_ws(",", F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["s"].cast("string"), x["e"].cast("string"))))


def _scanned(docs: DataFrame, text: str) -> DataFrame:
    """(row: all columns of ``docs``, text, a column of spans per base kind, base, spans)."""
    first = docs.select(F.struct("*").alias("row"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    first = first.select("row", "text", *(found(F.col("text"), k).alias(k) for k in KINDS))
    c = {k: F.col(k) for k in KINDS}
    ids, keys = F.concat(c["access"], c["account"]), F.concat(c["assign"], c["key40"])
    linked = [near(c["key40"], ids), near(c["account"], keys), near(near(c["address"], ids), keys)]
    base = F.array_sort(F.concat(*(c[k] for k in BASE)))
    return first.select("row", "text", *(c[k] for k in BASE), base.alias("base"), F.array_sort(F.concat(base, *linked)).alias("spans"))


def scan(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds ``base`` and ``spans`` (arrays of (s, r, kind, e), by start and then kind) to every row; columns of these names are replaced.

    A null or empty text has no spans. All other columns stay; rows may repeat; an
    empty table stays empty. Weak kinds: key40 needs an access or account identifier
    in its scope; account needs an assigned secret or a key40; address needs both an
    identifier and a secret.
    """
    return _scanned(docs, text).select(*(F.col("row").getField(c).alias(c) for c in docs.columns if c not in ("base", "spans")), "base", "spans")


def digests(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_assign, n_access, n_hex, base_sha256, spans: a row per row of ``docs``; other columns are not read."""
    s = _scanned(docs.select(key, text), text)
    counts = [F.size(k).cast("long").alias(f"n_{k}") for k in BASE]
    return s.select(F.col("row").getField(key).alias(key), *counts, F.sha2(shown(F.col("base")), 256).alias("base_sha256"), shown(F.col("spans")).alias("spans"))


def redacted(docs: DataFrame, text: str = "text", mark: str = "[secret]") -> DataFrame:
    """``docs`` with every span of its text replaced by ``mark`` (overlapping spans by one); texts without spans, null too, stay as they are.

    All columns stay, whatever their names. Pieces are cut from a form of four
    bytes a code point, where a place is found at once.
    """

    def cut(wide: Column) -> Column:
        piece = lambda lo, hi: F.decode(F.substring(wide, lo * 4 + 1, (hi - lo) * 4), "UTF-32")
        apart = F.filter(running(F.col("spans"), SPAN, lambda x: x["e"], F.greatest, F.lit(0)), lambda z: z["x"]["s"] >= z["before"])
        head = F.concat_ws(mark, F.transform(apart, lambda z: piece(z["before"], z["x"]["s"])))
        end = F.array_max(F.transform("spans", lambda x: x["e"]))
        return F.concat(head, F.lit(mark), piece(end, F.length("text")))

    s = _scanned(docs, text)
    new = F.when(F.size("spans") > 0, let(F.encode("text", "UTF-32"), cut)).otherwise(F.col("row").getField(text))
    return s.select(*((new if c == text else F.col("row").getField(c)).alias(c) for c in docs.columns))


def oracle(table: str = "documents") -> str:
    """The same in DuckDB's SQL: positions from the lengths of what regexp_split_to_array and regexp_extract_all give."""
    quote = lambda x: "'" + x.replace("'", "''") + "'"
    spans = []
    for rank, (kind, (pattern, least, group)) in enumerate(KINDS.items()):
        p = quote(pattern)
        ok = f"length(m[i]) = 40 and regexp_matches(m[i], '[A-Z]') and regexp_matches(m[i], '[a-z]') and regexp_matches(m[i], '[0-9]')" if kind == "key40" else f"length(regexp_extract(m[i], {p}, {group})) >= {least}"
        spans.append(f"""{kind} as (select rid, list({{'s': s, 'r': {rank}, 'kind': '{kind}', 'e': s + n}} order by s) x from (
  select rid, length(m[i]) n, {ok} ok, list_sum([length(y) for y in g[1:i]]) + coalesce(list_sum([length(y) for y in m[1:i-1]]), 0) s
  from (select rid, m, g, unnest(range(1, len(m) + 1)) i from (select rid, regexp_extract_all(t, {p}) m, regexp_split_to_array(t, {p}) g from d where regexp_matches(t, {p})))) where ok group by rid)""")
    names = ", ".join(f"coalesce({k}.x, []) as {k}" for k in KINDS)
    joins = " ".join(f"left join {k} on {k}.rid = d.rid" for k in KINDS)
    close = lambda x, y: f"len(list_filter({y}, lambda o: o.s < {x}.e + {SCOPE} and {x}.s < o.e + {SCOPE})) > 0"
    text = lambda x: f"array_to_string(list_transform({x}, lambda z: z.kind || ':' || z.s || ':' || z.e), ',')"
    return f"""with d as (select row_number() over () rid, doc_id, coalesce(text, '') t from {table}), {', '.join(spans)},
a as (select d.doc_id, {names} from d {joins}),
b as (select *, list_concat(access, account) ids, list_concat(assign, key40) keys, list_sort(list_concat(assign, list_concat(access, hex))) base from a),
c as (select *, list_sort(list_concat(base, list_concat(list_filter(key40, lambda x: {close('x', 'ids')}), list_concat(list_filter(account, lambda x: {close('x', 'keys')}), list_filter(address, lambda x: {close('x', 'ids')} and {close('x', 'keys')}))))) spans from b)
select doc_id, len(assign)::bigint n_assign, len(access)::bigint n_access, len(hex)::bigint n_hex, sha256({text('base')}) base_sha256, {text('spans')} spans from c"""
