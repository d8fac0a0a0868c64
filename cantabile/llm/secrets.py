"""Secrets in texts, with multipart credentials linked: built-in functions only.

Strong spans stand alone: values given to a password, secret, token or API key (assign), key ids with a fixed head (access), and
long hexadecimal runs (hex). Weak ones say little alone: names given to a user, login or client id (login), long runs of mixed
letters and digits (bare), and addresses (endpoint). An access identifier, strong or weak, has a scope of REACH code
points to either side. Weak parts are reported only where complementary ones co-occur:

- a login, if a secret (assign, hex or bare) begins in its scope;
- a bare secret, if it begins in the scope of an access identifier (access or login);
- an endpoint, if it begins in the scope of an access identifier in whose scope a secret begins too.

Each text is scanned by itself, where it lies. Spans come from the texts between matches (their lengths, summed in blocks), so a text of many
matches costs no more than in proportion. Scopes meet parts by an interval join: equal row and bucket of REACH code points, then a comparison
of places, as semi-joins, so no pairs are made. Only spans are shuffled, by row and bucket, so a long text spreads over tasks.

Defined results: a null text counts as empty; a text without a span has none; null and equal keys are no matter, as each row
is its own scope; an empty table gives an empty result; extra columns are ignored. Places are code points, the end exclusive.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cantabile.llm.common import checkpoint, table

# What a span looks like; group 2 of the first and fourth pattern is the value.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
LOGIN = r"""(?i)(access_?key_?id|client_?id|user_?name|user|login|account)["']?\x20*[:=]\x20*["']?([A-Za-z0-9@+/_.=-]+)"""
BARE = r"[A-Za-z0-9+/]{32,}"
ENDPOINT = r"""[a-z][a-z0-9]{1,9}://[^\x20\x09-\x0D"'<>]+"""
LEAST_VALUE, MOST_BARE = 6, 128
#: What must be in a text for the pattern to match; a cheaper search than that for spans.
ASSIGN_SIGN = r"(?i)[psta](?:assword|asswd|ecret|oken|pi_?key)[\x22']?\x20*[:=]"
LOGIN_SIGN = r"(?i)(?:_?id|user|name|login|account)[\x22']?\x20*[:=]"

KINDS = ("assign", "access", "hex", "login", "bare", "endpoint")
REACH = 240
#: Matches of a block of prefix sums.
BLOCK = 256


def once(value: Column, use) -> Column:
    """use(value), a variable in it, so that Spark computes it one time however often it is named."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def spans(text: Column, pattern: str, keep=None) -> Column:
    """array<struct<start, end>> of the leftmost matches that don't overlap; keep(match) says which of them count."""
    none = F.array().cast("array<struct<start:int,end:int,keep:boolean>>")

    def sums(blocks: Column) -> Column:
        """Places before each block."""
        of = F.transform(blocks, lambda b: F.aggregate(b, F.lit(0), lambda at, x: at + x["gap"] + x["size"]))
        return F.aggregate(of, F.array(F.lit(0)), lambda at, n: F.concat(at, F.array(F.element_at(at, -1) + n)))

    def placed(block: Column, first: Column) -> Column:
        made = lambda s, x: F.struct((s["at"] + x["gap"]).alias("start"), (s["at"] + x["gap"] + x["size"]).alias("end"), x["keep"].alias("keep"))
        start = F.struct(first.alias("at"), none.alias("of"))
        return F.aggregate(block, start, lambda s, x: F.struct((s["at"] + x["gap"] + x["size"]).alias("at"), F.concat(s["of"], F.array(made(s, x))).alias("of")), lambda s: s["of"])

    def steps(matches: Column) -> Column:
        """Length of the text before each match, of the match, and whether it counts."""
        before = F.transform(F.slice(F.split(text, pattern, -1), F.lit(1), F.size(matches)), lambda x: F.length(x))
        test = F.transform(matches, (lambda m: F.lit(True)) if keep is None else keep)
        return F.arrays_zip(before.alias("gap"), F.transform(matches, lambda m: F.length(m)).alias("size"), test.alias("keep"))

    def blocks(s: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.floor((F.size(s) - 1) / BLOCK).cast("int")), lambda i: F.slice(s, i * BLOCK + 1, F.lit(BLOCK)))

    def of_blocks(b: Column) -> Column:
        return F.filter(F.flatten(F.zip_with(b, F.slice(sums(b), F.lit(1), F.size(b)), placed)), lambda x: x["keep"])

    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    for step in (steps, blocks, of_blocks):
        found = once(found, step)
    return F.transform(found, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end")))


def named(found: Column, kind: str) -> Column:
    return F.transform(found, lambda x: F.struct(x["start"].alias("start"), F.lit(KINDS.index(kind)).alias("kind"), x["end"].alias("end")))


NO_SPANS = "array<struct<start:int,kind:int,end:int>>"


def written(found: Column) -> Column:
    """kind:start:end of spans, by start and kind, as one text."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(F.sort_array(found), lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["start"], x["end"])), ",")


def scanned(docs: DataFrame, keys: list[str], text_col: str) -> DataFrame:
    """keys, _row, strong and weak spans of each row, written once."""
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    none = F.array().cast(NO_SPANS)
    long_value = lambda m: F.length(F.regexp_extract(m, ASSIGN, 2)) >= LEAST_VALUE
    mixed = lambda m: (F.length(m) <= MOST_BARE) & m.rlike("[a-z]") & m.rlike("[A-Z]") & m.rlike("[0-9]")
    of = lambda test, kind, pattern, keep=None: F.when(test, named(spans(F.col("_text"), pattern, keep), kind)).otherwise(none)
    t = F.col("_text")
    assigned = t.contains(":") | t.contains("=")
    rows = docs.select(*(F.col(f"`{k}`") for k in keys), text.alias("_text"))
    rows = rows.withColumns({"_a": of(assigned & t.rlike(ASSIGN_SIGN), "assign", ASSIGN, long_value), "_k": of(t.contains("AKIA"), "access", ACCESS), "_h": of(t.rlike(HEX), "hex", HEX), "_l": of(assigned & t.rlike(LOGIN_SIGN), "login", LOGIN)})
    # without an access identifier no weak part is reported
    some = (F.size("_k") > 0) | (F.size("_l") > 0)
    weak = F.when(some, F.concat("_l", of(t.rlike(BARE), "bare", BARE, mixed), of(t.contains("://"), "endpoint", ENDPOINT))).otherwise(none)
    return checkpoint(rows.select(*(F.col(f"`{k}`") for k in keys), F.monotonically_increasing_id().alias("_row"), F.concat("_a", "_k", "_h").alias("_strong"), weak.alias("_weak")))


def linked(rows: DataFrame, reach: int = REACH) -> DataFrame:
    """(_row, _added): weak spans that complementary ones confirm. rows: _row, _strong, _weak."""
    kind = {k: i for i, k in enumerate(KINDS)}
    parts = rows.where(F.size("_weak") > 0).select("_row", F.explode(F.concat("_strong", "_weak")).alias("_p")).select("_row", "_p.*").withColumn("bucket", F.floor(F.col("start") / reach))
    access = parts.where(F.col("kind").isin(kind["access"], kind["login"])).drop("bucket")
    scopes = access.withColumn("bucket", F.explode(F.sequence(F.floor((F.col("start") - reach) / reach), F.floor((F.col("end") + reach - 1) / reach))))
    secrets = parts.where(F.col("kind").isin(kind["assign"], kind["hex"], kind["bare"]))

    def inside(part: str, scope: str) -> Column:
        p, s = (lambda c: F.col(f"{part}.{c}")), (lambda c: F.col(f"{scope}.{c}"))
        return (p("_row") == s("_row")) & (p("bucket") == s("bucket")) & (p("start") >= s("start") - reach) & (p("start") < s("end") + reach)

    whole = scopes.alias("s").join(secrets.alias("p"), inside("p", "s"), "left_semi")  # scopes with a secret, one row for each bucket where there is one
    whole = whole.select("_row", "start", "kind", "end").distinct()
    again = whole.withColumn("bucket", F.explode(F.sequence(F.floor((F.col("start") - reach) / reach), F.floor((F.col("end") + reach - 1) / reach))))
    bare = secrets.where(F.col("kind") == kind["bare"]).alias("p").join(scopes.alias("s"), inside("p", "s"), "left_semi")
    ends = parts.where(F.col("kind") == kind["endpoint"]).alias("p").join(again.alias("s"), inside("p", "s"), "left_semi")
    told = [whole.where(F.col("kind") == kind["login"]), bare.select("_row", "start", "kind", "end"), ends.select("_row", "start", "kind", "end")]
    return told[0].unionByName(told[1]).unionByName(told[2]).groupBy("_row").agg(F.collect_list(F.struct("start", "kind", "end")).alias("_added"))


def find_secrets(docs: DataFrame, keys: list[str], text_col: str = "text", reach: int = REACH) -> DataFrame:
    """A row for each row of docs: keys, strong and added spans (start, kind as a place in KINDS, end), each in order."""
    rows = scanned(docs, keys, text_col)
    out = rows.join(linked(rows, reach), "_row", "left")
    return out.select(*(F.col(f"`{k}`") for k in keys), F.sort_array("_strong").alias("strong"), F.sort_array(F.coalesce("_added", F.array().cast(NO_SPANS))).alias("added"))


def op12_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_secrets(table(spark, sf_dir, "documents"), ["doc_id"])
    count = lambda kind: F.size(F.filter("strong", lambda x: x["kind"] == KINDS.index(kind))).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *map(count, KINDS[:3]), F.sha2(written(F.col("strong")), 256).alias("base_sha256"), written(F.concat("strong", "added")).alias("spans"))
