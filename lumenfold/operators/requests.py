"""Planning of generation requests: expansion, resume, manifests, few-shot prefixes."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lumenfold.functions.estimators import let
from lumenfold.functions.names import fresh
from lumenfold.functions.predicates import is_finite
from lumenfold.functions.text import request_seed
from lumenfold.operators.samples import assign_sample_index


def valid_ids(rows: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """One row (rows, distinct, blank, valid): whether there is a row and every id is unique and not blank."""
    text = F.trim(F.col(doc_id).cast("string"))
    found = rows.agg(F.count("*").alias("rows"), F.count_distinct(text).alias("distinct"), F.count_if(F.coalesce(text, F.lit("")) == "").alias("blank"))
    return found.withColumn("valid", (F.col("rows") > 0) & (F.col("blank") == 0) & (F.col("distinct") == F.col("rows")))


def expand(questions: DataFrame, n_samples: int) -> DataFrame:
    """Each question once for every sample index below n_samples."""
    return questions.withColumn("sample_index", F.explode(F.sequence(F.lit(0), F.lit(n_samples - 1)))).withColumn("n_samples", F.lit(n_samples))


def usable_outputs(outputs: DataFrame, text: str = "gen") -> DataFrame:
    """Output rows that count as done: with an id, a generation, and no negative index."""
    named = F.coalesce(F.trim(F.col("doc_id").cast("string")), F.lit("")) != ""
    return outputs.filter(named & F.col(text).isNotNull() & (F.col("sample_index").isNull() | (F.col("sample_index") >= 0)))


def usable_logprobs(outputs: DataFrame) -> DataFrame:
    """Output rows of choices by log-probability that count as done: one for each choice and each choice token (where the
    row has them), null or finite, one of them finite at least, and a gold among them."""
    n = F.size("logprobs")
    same = lambda c: F.col(c).isNull() | (F.size(c) == n)
    fits = [same(c) for c in ("choices", "choice_tokens") if c in outputs.columns]
    scores = F.forall("logprobs", lambda x: x.isNull() | is_finite(x)) & F.exists("logprobs", lambda x: x.isNotNull())
    fine = (n > 0) & (F.col("gold") >= 0) & (F.col("gold") < n) & scores
    for f in fits:
        fine = fine & f
    named = F.coalesce(F.trim(F.col("doc_id").cast("string")), F.lit("")) != ""
    return outputs.filter(named & F.coalesce(fine, F.lit(False)) & (F.col("sample_index").isNull() | (F.col("sample_index") >= 0)))


def resume_state(outputs: DataFrame, ordinal: str = "ordinal", usable: Callable[[DataFrame], DataFrame] = usable_outputs) -> DataFrame:
    """(doc_id, sample_index, prompt, n_samples) that are done; rows without an index take the next free one."""
    numbered = assign_sample_index(usable(outputs), "doc_id", ordinal)
    return numbered.groupBy("doc_id", "sample_index").agg(F.min("prompt").alias("prompt"), F.max("n_samples").alias("n_samples"))


def remaining(questions: DataFrame, done: DataFrame, n_samples: int) -> DataFrame:
    """The requests that are still to be made."""
    return expand(questions, n_samples).join(done.select("doc_id", "sample_index"), ["doc_id", "sample_index"], "left_anti")


def drift(questions: DataFrame, done: DataFrame, n_samples: int) -> DataFrame:
    """(doc_id, fault) where outputs do not belong to this run: another prompt, another depth, an index beyond it."""
    state = done.groupBy("doc_id").agg(F.min("prompt").alias("p_min"), F.max("prompt").alias("p_max"), F.max("n_samples").alias("n"), F.max("sample_index").alias("most"))
    both = questions.select("doc_id", "prompt").join(state, "doc_id")
    checks = {"prompt": (F.col("prompt") != F.col("p_min")) | (F.col("prompt") != F.col("p_max")), "n_samples": F.col("n") != n_samples, "out_of_range": F.col("most") >= n_samples}
    faults = F.filter(F.array(*[F.when(c, F.lit(k)) for k, c in checks.items()]), lambda x: x.isNotNull())
    return both.select("doc_id", F.explode(faults).alias("fault"))


def reconcile(manifest: DataFrame, outputs: DataFrame, n_samples: int) -> DataFrame:
    """One row (expected, matched, missing, unexpected, duplicates) of outputs against a manifest's ids."""
    wanted = expand(manifest.select("doc_id").distinct(), n_samples).select("doc_id", "sample_index")
    keyed = outputs.filter("doc_id is not null and sample_index >= 0")
    actual = keyed.groupBy("doc_id", "sample_index").agg(F.count("*").alias("rows"), F.max("n_samples").alias("n"))
    both = wanted.withColumn("w", F.lit(1)).join(actual.withColumn("a", F.lit(1)), ["doc_id", "sample_index"], "full_outer")
    hit = F.col("w").isNotNull() & F.col("a").isNotNull() & (F.coalesce(F.col("n"), F.lit(n_samples)) == n_samples)
    found = both.agg(F.count("w").alias("expected"), F.count_if(hit).alias("matched"), F.count("a").alias("seen"), F.coalesce(F.sum("rows"), F.lit(0)).alias("rows"))
    keyless = outputs.agg((F.count("*") - F.count_if(F.expr("doc_id is not null and sample_index >= 0"))).alias("invalid"))
    return found.join(F.broadcast(keyless)).select(  # one row each
        "expected", "matched", (F.col("expected") - F.col("matched")).alias("missing"), (F.col("seen") - F.col("matched") + F.col("invalid")).alias("unexpected"), (F.col("rows") - F.col("seen")).alias("duplicates")
    )


#: Rounds of the permutation that chooses demonstrations.
ROUNDS = 4


def _permuted(x: Column, n: Column, key: Column) -> Column:
    """The x-th number (from 0) of a pseudo-random permutation of 0 to n - 1 that the key names.

    A number is a pair of digits, of a and of b values; each round adds a hash of one digit to the other. a times b is
    n or a little more, so numbers of n or more are permuted again until one is below n, which comes soon: there
    are fewer than a of them.
    """
    a = F.ceil(F.sqrt(n.cast("double")))
    b = F.ceil(n / a.cast("double"))

    def hashed(k: int, digit: Column) -> Column:
        return F.conv(F.substring(F.sha2(F.concat_ws(":", key, F.lit(str(k)), digit.cast("string")), 256), 1, 8), 16, 10).cast("long")

    def after(k: int) -> Callable[[Column], Column]:
        if k % 2:
            return lambda s: F.struct(s["l"].alias("l"), ((s["r"] + hashed(k, s["l"])) % b).alias("r"))
        return lambda s: F.struct(((s["l"] + hashed(k, s["r"])) % a).alias("l"), s["r"].alias("r"))

    def shuffled(x: Column) -> Column:
        state = F.struct((x % a).alias("l"), F.floor(x / a).cast("long").alias("r"))
        for k in range(ROUNDS):
            state = let(state, after(k))
        return let(state, lambda s: s["l"] + a * s["r"])

    walks = F.sequence(F.lit(1), F.greatest(F.lit(1), F.least(F.lit(64), a * b - n)).cast("int"))
    start = shuffled(x)
    return F.aggregate(walks, start, lambda now, _: F.when(now < n, now).otherwise(shuffled(now)))


def few_shot_prefixes(questions: DataFrame, pool: DataFrame, shots: int, seed: int = 42) -> DataFrame:
    """(doc_id, prefix): for each question `shots` demonstrations, chosen by seed and question; never itself.

    The pool is numbered by (prompt, id, answer), so that demonstrations with the question's own prompt are a range of
    numbers, which is left out of a pseudo-random permutation of the numbers; those with its id are passed over.
    A question is a row for each demonstration that it looks at, `shots` and as many as share its id, and these
    rows, without texts of the question, are joined with the pool by number.
    """
    demos = pool.select(F.col("doc_id").cast("string").alias("id"), "prompt", F.concat("prompt", F.lit(" "), "answer").alias("demo"))
    keyed = number_rows(demos, F.struct("prompt", "id", "demo"), "number")
    size = keyed.count()
    ranges = keyed.groupBy(F.col("prompt").alias("__prompt")).agg(F.min("number").alias("__from"), F.count("*").alias("__own"))
    ids = keyed.filter("id is not null").groupBy(F.col("id").alias("__id")).agg(F.count("*").alias("__same"))
    asked = questions.select(F.col("doc_id"), F.col("doc_id").cast("string").alias("__of"), "prompt", F.monotonically_increasing_id().alias("__q"))
    asked = asked.join(ranges, F.col("prompt") == F.col("__prompt"), "left").join(ids, F.col("__of") == F.col("__id"), "left")
    own, same = F.coalesce("__own", F.lit(0)), F.coalesce("__same", F.lit(0))
    key = F.concat_ws(":", F.lit(str(seed)), F.col("__of"), F.col("prompt"))
    drawn = asked.select("doc_id", "__of", "__q", F.sha2(key, 256).alias("__key"), F.coalesce("__from", F.lit(0)).alias("__from"), own.alias("__own"), (F.lit(size) - own).alias("__n"), (F.lit(shots) + same).alias("__want"))
    places = F.sequence(F.lit(0), (F.least("__want", "__n") - 1).cast("int"))
    # A question without enough of them keeps a row, with no number, and fails below.
    looked = drawn.withColumn("__place", F.explode_outer(F.when(F.col("__n") > 0, places)))
    at = _permuted(F.col("__place").cast("long"), F.col("__n"), F.col("__key"))
    looked = looked.select("doc_id", "__of", "__q", "__place", F.when(F.col("__place").isNotNull(), let(at, lambda y: F.when(y < F.col("__from"), y).otherwise(y + F.col("__own")))).alias("__at"))
    found = looked.join(keyed.select(F.col("number").alias("__at"), F.col("id").alias("__id"), "demo"), "__at", "left")
    fits = F.col("demo").isNotNull() & ~F.coalesce(F.col("__id") == F.col("__of"), F.lit(False))
    held = found.groupBy("__q", "doc_id").agg(F.slice(F.array_sort(F.collect_list(F.when(fits, F.struct("__place", "demo")))), 1, shots).alias("best"))
    enough = F.when(F.size("best") < shots, F.raise_error(F.concat(F.lit("too few demonstrations for "), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")))).cast("string"))
    return held.select("doc_id", F.coalesce(enough, F.concat(F.array_join("best.demo", "\n\n"), F.lit("\n\n"))).alias("prefix"))


def with_seeds(requests: DataFrame, seed: int, prompt: str = "prompt") -> DataFrame:
    return requests.withColumn("seed", request_seed(seed, F.col("doc_id"), F.col(prompt), F.col("sample_index")))


def _checkpoints(spark: SparkSession) -> str:
    """The folder of checkpoints; spark.checkpoint.dir, or a temporary one in local mode where that is unset."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="lumenfold-"))
    return context.getCheckpointDir()


def scratch(spark: SparkSession, what: str) -> str:
    """A new path in the folder of checkpoints, which all executors share."""
    return f"{_checkpoints(spark).rstrip('/')}/{what}-{uuid.uuid4().hex}"


def number_rows(rows: DataFrame, order: Column, into: str = "number", group: str | None = None) -> DataFrame:
    """rows with their place (from 0) in `order`, by range partitions and their sizes: no task sorts all rows.

    rows are worked out once, into a checkpoint; the ranges come from a sample of it, so they are fixed by a second
    one before they are counted and used. Rows with texts are better joined with their numbered keys. With group,
    places are counted in each of its values; a value's rows may stand in many ranges.
    """
    _checkpoints(rows.sparkSession)
    key, part, within, before = fresh([*rows.columns, into], "__key", "__part", "__in", "__before")
    kept = rows.withColumn(key, order).checkpoint()
    by = [F.col(group), F.col(key)] if group else [F.col(key)]
    spread = kept.repartitionByRange(*by).withColumn(part, F.spark_partition_id()).checkpoint()
    inside = [part, group] if group else [part]
    ranked = spread.withColumn(within, F.row_number().over(Window.partitionBy(*inside).orderBy(key)) - 1)
    earlier = Window.partitionBy(group) if group else Window
    sums = F.coalesce(F.sum("count").over(earlier.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = spread.groupBy(*inside).count().select(*inside, sums.alias(before))  # ranges and groups together, at most
    if group:
        mine, theirs = fresh([*ranked.columns, before], "__p", "__g")
        starts = starts.select(F.col(part).alias(mine), F.col(group).alias(theirs), before)
        joined = ranked.join(starts, (F.col(part) == F.col(mine)) & F.col(group).eqNullSafe(F.col(theirs))).drop(mine, theirs)
    else:
        joined = ranked.join(F.broadcast(starts), part)  # a row for each range
    names = [c for c in rows.columns if c.lower() != into.lower()]
    return joined.withColumn(into, F.col(before) + F.col(within)).select(*[F.col(f"`{c}`") for c in names], into)


def equal_shards(rows: DataFrame, shards: int, order: Column) -> DataFrame:
    """rows with shard (from 0): contiguous by `order`, the first ones larger by a row where they cannot be equal."""
    total = rows.count()
    base, extra = divmod(total, shards)
    (name,) = fresh(rows.columns, "__at")
    at, wide = F.col(name), extra * (base + 1)
    shard = F.when(at < wide, F.floor(at / (base + 1))).otherwise(extra + F.floor((at - wide) / max(base, 1)))
    return number_rows(rows, order, name).withColumn("shard", shard.cast("int")).drop(name)


def round_robin(rows: DataFrame, workers: int, order: Column) -> DataFrame:
    """rows with worker: their places in `order` dealt out in turn."""
    (name,) = fresh(rows.columns, "__at")
    return number_rows(rows, order, name).withColumn("worker", (F.col(name) % workers).cast("int")).drop(name)


def batches(rows: DataFrame, size: int, order: Column) -> DataFrame:
    """rows with batch: runs of `size` in `order`."""
    (name,) = fresh(rows.columns, "__at")
    return number_rows(rows, order, name).withColumn("batch", F.floor(F.col(name) / size).cast("int")).drop(name)
