"""Secret scans with multipart credential linking, with DataFrame functions only."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import store, table

# The base patterns (pattern, group whose length counts, its least length), in the order of the contract.
BASE = {
    "assign": (r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    "access": (r"AKIA[A-Z0-9]+", 0, 18),
    "hex": (r"[0-9a-f]{16,}", 0, 16),  # of runs of these letters, those of 16 or more
}
#: Parts that are weak on their own: reported only beside a part that complements them.
WEAK = {
    "identifier": (r"""(?i)(access_?key_?id|client_?id|user_?name|user|login|account)["']?\x20*[:=]\x20*["']?([A-Za-z0-9._@+-]+)""", 2, 3),
    "weak_secret": (r"""(?i)(pass|pwd|credential|private_?key|auth)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    # the secret half of a key pair by name; what stands there may be the identifier
    "key_secret": (r"""(?i)((?:secret[_-]?(?:access[_-]?)?|access[_-]?|account[_-]?)key|(?<![A-Za-z0-9_-])key)["']?\x20*[:=]\x20*["']?(?!(?-i:AKIA[A-Z0-9]))([A-Za-z0-9+/_.=-]+)""", 2, 6),
    # without a name: 40 characters as key pairs have them, not all of them lower-case hex digits
    "bare_secret": (r"""(?<![A-Za-z0-9+/_.:-])(?![0-9a-f]{40})[A-Za-z0-9+/]{40}(?![A-Za-z0-9+/_.=-])""", 0, 40),
    "endpoint": (r"""(?i)(https?|jdbc|postgres|postgresql|mysql|mongodb|redis|amqp|ftp|s3)://[A-Za-z0-9_.:/@?&=%-]+""", 0, 8),
}
#: The part that each kind plays, and the parts that complement it.
ROLE = {"assign": "secret", "hex": "secret", "weak_secret": "secret", "key_secret": "secret", "bare_secret": "secret", "access": "identifier", "identifier": "identifier", "endpoint": "endpoint"}
COMPLEMENTS = {"secret": ("identifier", "endpoint"), "identifier": ("secret",), "endpoint": ("secret",)}


def _hits(text: Column, kind: str, pattern: str, group: int) -> Column:
    """Every match of pattern, leftmost and not overlapping: its place in order, the text before it since the last, and lengths.

    A short value of assign is a weak secret, if it is long enough for one.
    """
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    values = F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    gaps = F.transform(F.split(text, pattern, -1), F.char_length)
    hits = F.transform(
        F.arrays_zip(F.transform(found, F.char_length).alias("length"), F.transform(values, F.char_length).alias("value"), F.slice(gaps, F.lit(1), F.size(found)).alias("gap")),
        lambda x, i: F.struct(F.lit(kind).alias("kind"), i.alias("at"), x["gap"].alias("gap"), x["length"].alias("length"), x["value"].alias("value")),
    )
    return F.when(text.rlike(pattern), hits)


def find_spans(docs: DataFrame, scope: int = 256) -> DataFrame:
    """Per row of docs: row_id, doc_id and spans, an array of (start, rank, kind, end, base) in order of start and kind.

    Offsets are code points, ends exclusive.  Base spans (kinds of BASE) always stay.  Weak parts (kinds of WEAK) are
    linked: an interval join within the document finds, for each of them, a part of a complementary role at most
    `scope` code points away: a secret needs an identifier or an endpoint, these need a secret.  Parts that have none
    are not reported.  The join is a semi join on blocks of `scope` code points, so that a part is one row however many
    complement it.

    Null and empty texts have no spans.  Null or repeated doc_ids are rows like others: row_id tells rows apart.  Only
    doc_id and text are read, so that other columns may have any name.  An empty table gives an empty result.
    """
    kinds = BASE | WEAK
    text = F.col("text")
    every = F.concat(*(F.coalesce(_hits(text, k, p, g), F.array().cast("array<struct<kind:string,at:int,gap:int,length:int,value:int>>")) for k, (p, g, _) in kinds.items()))
    rows = docs.select(F.monotonically_increasing_id().alias("row_id"), "doc_id", every.alias("hits"))
    hits = store(rows.select("row_id", "doc_id", F.explode_outer("hits").alias("hit")).select("row_id", "doc_id", "hit.*"), "secret-hits")

    before = Window.partitionBy("row_id", "kind").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    placed = hits.where("kind is not null").withColumn("end", F.sum(F.col("gap") + F.col("length")).over(before).cast("long"))
    placed = placed.withColumn("start", F.col("end") - F.col("length"))
    least = reduce(lambda c, k: c.when(F.col("kind") == k, kinds[k][2]), list(kinds)[1:], F.when(F.col("kind") == "assign", BASE["assign"][2]))
    long_enough = F.col("value") >= least
    weak_assign = (F.col("kind") == "assign") & F.col("value").between(WEAK["weak_secret"][2], BASE["assign"][2] - 1)
    parts = placed.where(long_enough | weak_assign).select(
        "row_id", F.when(weak_assign, "weak_secret").otherwise(F.col("kind")).alias("kind"), "start", "end"
    )
    parts = parts.distinct()
    role = F.create_map(*(F.lit(x) for pair in ROLE.items() for x in pair))[F.col("kind")]
    parts = parts.withColumn("role", role)

    weak = parts.where(F.col("kind").isin(*WEAK))
    needed = F.create_map(*(x for k, v in COMPLEMENTS.items() for x in (F.lit(k), F.array(*map(F.lit, v)))))[F.col("role")]
    reach = F.sequence(F.floor((F.col("start") - scope) / scope), F.floor((F.col("end") + scope) / scope))
    asking = weak.withColumn("need", F.explode(needed)).withColumn("block", F.explode(reach))
    # a part stands in each block that it touches
    given = parts.select(
        F.col("row_id").alias("g_row"), F.col("role").alias("g_role"), F.col("start").alias("g_start"), F.col("end").alias("g_end"),
        F.explode(F.sequence(F.floor(F.col("start") / scope), F.floor(F.col("end") / scope))).alias("g_block"),
    )
    near = (F.col("g_start") <= F.col("end") + scope) & (F.col("g_end") >= F.col("start") - scope)
    linked = asking.join(given, (F.col("row_id") == F.col("g_row")) & (F.col("need") == F.col("g_role")) & (F.col("block") == F.col("g_block")) & near, "left_semi")
    reported = parts.where(F.col("kind").isin(*BASE)).select("row_id", "kind", "start", "end").unionByName(linked.select("row_id", "kind", "start", "end").distinct())

    rank = F.create_map(*(x for i, k in enumerate(kinds) for x in (F.lit(k), F.lit(i))))[F.col("kind")]
    span = F.struct("start", rank.alias("rank"), "kind", "end", F.col("kind").isin(*BASE).alias("base"))
    of_row = reported.groupBy("row_id").agg(F.array_sort(F.collect_list(span)).alias("spans"))
    none = F.array().cast("array<struct<start:bigint,rank:int,kind:string,end:bigint,base:boolean>>")
    return (
        hits.select("row_id", "doc_id").distinct()
        .join(of_row, "row_id", "left")
        .select("row_id", "doc_id", F.coalesce("spans", none).alias("spans"))
    )


def _written(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def query(spark, sf_dir: str) -> DataFrame:
    found = find_spans(table(spark, sf_dir, "documents"))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    return found.select(
        "doc_id", *(count(k).alias(f"n_{k}") for k in BASE),
        F.sha2(_written(F.filter("spans", lambda s: s["base"])), 256).alias("base_sha256"), _written(F.col("spans")).alias("spans"),
    )
