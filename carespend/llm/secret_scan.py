"""Secret scans whose verdict rests on how widely a value is owned and copied."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from carespend.llm.joins import sized
from carespend.sources.io import stage

# The base patterns, the group that holds the value and the least length of that group.
BASE = (
    ("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    ("access", r"AKIA[A-Z0-9]{12,}", 0, 16),
    ("hex", r"[0-9a-f]{32,}", 0, 32),
)
#: A further kind, kept only where one owner alone has the value, in few repositories: long runs with letters of both cases and digits.
OWNED = ("owned", r"[A-Za-z0-9+/_-]{24,}={0,2}", 0, 24)
MIXED = r"(?=.*[0-9])(?=.*[a-z])(?=.*[A-Z])"
#: Owners from which on a value is a copied example.
EXAMPLE_OWNERS = 3
#: Repositories from which on a value is a copied example, even if one owner has them all.
EXAMPLE_REPOS = 10
#: Numbers that are added up one by one; longer arrays are summed by blocks first.
SUMMED = 128

SPAN = "array<struct<start:int,kind:int,end:int,value:bigint>>"


def running_before(df: DataFrame, lengths: str, out: str) -> DataFrame:
    """``out``: for each element of an array column the sum of the elements before it.

    Arrays that a lambda refers to are fields of one column: the optimizer would compute a
    column that is named once again for each element.
    """
    add = lambda a, x: a + x
    total = lambda a: F.aggregate(a, F.lit(0), add)
    size = F.size(lengths)
    firsts = F.when(size > 0, F.sequence(F.lit(0), size - 1, F.lit(SUMMED))).otherwise(F.array().cast("array<int>"))
    df = df.withColumn("_blocks", F.transform(firsts, lambda k: F.slice(lengths, k + 1, SUMMED)))
    grown = F.aggregate("_blocks", F.array(F.lit(0)), lambda a, x: F.concat(a, F.array(F.element_at(a, -1) + total(x))))
    df = df.withColumn("_both", F.struct(grown.alias("heads"), F.col("_blocks").alias("blocks")))
    block = lambda i: (i / SUMMED).cast("int")
    inner = lambda i: total(F.slice(F.get("_both.blocks", block(i)), F.lit(1), i - block(i) * SUMMED))
    return df.withColumn(out, F.transform(lengths, lambda _, i: F.get("_both.heads", block(i)) + inner(i))).drop("_blocks", "_both")


def spans(df: DataFrame, number: int, pattern: str, group: int, least: int, out: str) -> DataFrame:
    """``out``: the leftmost non-overlapping matches of a pattern in ``text``, those whose group is long enough.

    The text between matches is what splitting leaves, so positions are running sums of lengths.
    """
    matches = F.regexp_extract_all("text", F.lit(pattern), F.lit(0)).alias("whole")
    values = F.regexp_extract_all("text", F.lit(pattern), F.lit(group)).alias("value")
    found = F.struct(matches, F.split("text", pattern, -1).alias("before"), values)
    none = F.array().cast("array<string>")
    df = df.withColumn("_f", F.when(F.col("text").rlike(pattern), found).otherwise(F.struct(none.alias("whole"), none.alias("before"), none.alias("value"))))
    steps = F.transform("_f.whole", lambda m, i: F.length(F.get("_f.before", i)) + F.length(m))
    df = running_before(df.withColumn("_steps", steps), "_steps", "_at")
    df = df.withColumn("_g", F.struct("_f", "_at"))
    start = lambda i: F.get("_g._at", i) + F.length(F.get("_g._f.before", i))
    span = F.transform(
        "_g._f.whole",
        lambda m, i: F.struct(
            start(i).alias("start"), F.lit(number).alias("kind"), (start(i) + F.length(m)).alias("end"), F.get("_g._f.value", i).alias("text")
        ),
    )
    long_enough = F.filter(span, lambda s: F.length(s["text"]) >= least)
    return df.withColumn(out, long_enough).drop("_f", "_g", "_steps", "_at")


def candidates(docs: DataFrame, id_col: str, text_col: str, repo_col: str, owner_col: str) -> DataFrame:
    """Per row of ``docs`` its id, repository, owner, the base spans and further candidate spans with hashes of their values."""
    df = docs.select(
        F.col(id_col).alias("doc_id"), F.col(repo_col).alias("repo"), F.col(owner_col).alias("owner"), F.coalesce(F.col(text_col), F.lit("")).alias("text")
    ).withColumn("row", F.xxhash64("text"))
    hashed = lambda c: F.transform(c, lambda s: F.struct(s["start"], s["kind"], s["end"], F.xxhash64(s["text"]).alias("value"))).cast(SPAN)
    for number, (name, *rule) in enumerate((*BASE, OWNED)):
        df = spans(df, number, *rule, f"_{name}")
    mixed = F.filter("_owned", lambda s: s["text"].rlike(MIXED))
    df = df.withColumn("base", F.array_sort(F.concat(*(hashed(f"_{k[0]}") for k in BASE)))).withColumn("_more", hashed(mixed))
    more = F.filter("_more", lambda s: ~F.exists("base", lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"])))
    return df.select("doc_id", "row", "repo", "owner", "base", more.alias("more"))


def ownership(found: DataFrame) -> DataFrame:
    """``value, repos, owners``: in how many repositories and under how many owners each candidate value occurs."""
    occurrences = found.select("repo", "owner", F.explode(F.concat("base", "more")).alias("s")).select("repo", "owner", "s.value")
    # structs, as a null repository or owner counts as one
    return occurrences.groupBy("value").agg(F.countDistinct(F.struct("repo")).alias("repos"), F.countDistinct(F.struct("owner")).alias("owners"))


def written(spans_col: Column | str, names: Column) -> Column:
    """``kind:start:end`` of each span, comma-joined."""
    one = lambda s: F.concat(F.get(names, s["kind"]), F.lit(":"), s["start"].cast("string"), F.lit(":"), s["end"].cast("string"))
    return F.array_join(F.transform(spans_col, one), ",")


def scan(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    repo_col: str = "doc_id",
    owner_col: str = "source",
    example_owners: int = EXAMPLE_OWNERS,
    example_repos: int = EXAMPLE_REPOS,
) -> DataFrame:
    """Spans of secrets in each text, and how many of them look live.

    Values that match a base pattern are always reported. Hashes of all candidate values are
    counted over the corpus by distinct repository and owner: a value under ``example_owners``
    owners or more, or in ``example_repos`` repositories or more, is a copied example; one that
    a single owner has in fewer repositories looks live. Further long values are reported only
    if they look live.

    Returns a row per row of ``docs``: ``doc_id, n_assign, n_access, n_hex, n_owned, n_live,
    n_example, base, spans``; the last two list ``kind:start:end`` in code points by start.

    Null text counts as empty; null repositories and owners count as one each; rows that repeat
    an id are reported each. No rows give no rows; other columns are ignored, whatever their names.
    """
    found = stage(candidates(docs, id_col, text_col, repo_col, owner_col), "secret-candidates")
    names = F.array(*(F.lit(k[0]) for k in (*BASE, OWNED)))
    some = found.where(F.size("base") + F.size("more") > 0)
    rated = sized(ownership(some), "ownership")
    each = some.select("doc_id", "row", F.explode(F.concat("base", "more")).alias("s")).distinct()
    judged = each.join(rated, F.col("s.value") == rated["value"]).withColumn("live", (F.col("owners") == 1) & (F.col("repos") < example_repos)).where("s.kind < %d OR live" % len(BASE))
    copied = (F.col("owners") >= example_owners) | (F.col("repos") >= example_repos)
    count = lambda c: F.count(F.when(c, 1))
    totals = judged.groupBy("doc_id", "row").agg(
        F.array_sort(F.collect_list("s")).alias("all"), count(F.col("live")).alias("n_live"), count(copied).alias("n_example")
    )
    kept = some.alias("d").join(totals.alias("t"), F.col("d.doc_id").eqNullSafe(F.col("t.doc_id")) & (F.col("d.row") == F.col("t.row")), "left")
    kind = lambda c, k: F.size(F.filter(c, lambda s: s["kind"] == k)).cast("long")
    spans_of = F.coalesce("t.all", F.array().cast(SPAN))
    counts = lambda c: [kind(c, k).alias(f"n_{x[0]}") for k, x in enumerate((*BASE, OWNED))]
    reported = kept.select(
        "d.doc_id",
        *counts(spans_of),
        F.coalesce("n_live", F.lit(0)).alias("n_live"),
        F.coalesce("n_example", F.lit(0)).alias("n_example"),
        written("base", names).alias("base"),
        written(spans_of, names).alias("spans"),
    )
    zero, none = F.lit(0).cast("long"), F.lit("")
    clean = found.where(F.size("base") + F.size("more") == 0).select(
        "doc_id", *(zero.alias(f"n_{x[0]}") for x in (*BASE, OWNED)), zero.alias("n_live"), zero.alias("n_example"), none.alias("base"), none.alias("spans")
    )
    return reported.unionByName(clean)
