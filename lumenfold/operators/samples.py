"""Identity and numbering of the samples of a problem.

Every operator partitions by the problem, so a plan that chains them shuffles once.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lumenfold.functions.names import fresh
from lumenfold.functions.text import strip


def problem_identity(doc_id: Column, ordinal: Column) -> Column:
    """doc:<id>, or row:<ordinal> for a row without an id: each such row is a problem of its own."""
    named = F.coalesce(strip(doc_id.cast("string")), F.lit("")) != ""
    return F.when(named, F.concat(F.lit("doc:"), doc_id.cast("string"))).otherwise(F.concat(F.lit("row:"), ordinal.cast("string")))


def assign_sample_index(rows: DataFrame, problem: str = "problem", ordinal: str = "ordinal", index: str = "sample_index") -> DataFrame:
    """Rows without an index get the lowest unused ones of their problem, in the order of ordinal."""
    by = Window.partitionBy(problem)
    used_, nth_, n_ = fresh(rows.columns, "__used", "__nth", "__n")
    used = F.collect_set(index).over(by)
    nth = F.row_number().over(Window.partitionBy(problem, F.col(index).isNull()).orderBy(ordinal))
    numbered = rows.withColumns({used_: used, nth_: nth, n_: F.count("*").over(by)})
    free = F.array_except(F.sequence(F.lit(0), (F.col(n_) + F.coalesce(F.array_max(used_), F.lit(-1)) + 1).cast("int")), F.col(used_).cast("array<int>"))
    return numbered.withColumn(index, F.coalesce(F.col(index).cast("int"), F.element_at(free, F.col(nth_)))).drop(used_, nth_, n_)


def sample_faults(rows: DataFrame, problem: str = "problem", index: str = "sample_index", n_samples: str = "n_samples") -> DataFrame:
    """(problem, fault) of problems whose numbering cannot be: duplicate, negative, conflicting_n, out_of_range."""
    found = rows.groupBy(problem).agg(
        F.count(index).alias("given"), F.countDistinct(index).alias("distinct"), F.min(index).alias("least"), F.max(index).alias("most"),
        F.min(n_samples).alias("n_min"), F.max(n_samples).alias("n_max"),
    )
    checks = {
        "duplicate": F.col("given") > F.col("distinct"),
        "negative": F.col("least") < 0,
        "conflicting_n": F.col("n_min") < F.col("n_max"),
        "out_of_range": F.col("most") >= F.col("n_min"),
    }
    marked = F.filter(F.array(*[F.when(c, F.lit(name)) for name, c in checks.items()]), lambda x: x.isNotNull())
    return found.select(problem, F.explode(marked).alias("fault"))


def completeness(rows: DataFrame, problem: str = "problem", index: str = "sample_index", n_samples: str = "n_samples") -> DataFrame:
    """(problem, available, expected, missing indexes, complete); expected is n_samples, or the largest index and one."""
    found = rows.groupBy(problem).agg(F.collect_set(F.col(index).cast("int")).alias("have"), F.max(n_samples).alias("n"))
    expected = F.coalesce(F.col("n"), F.array_max("have") + 1).cast("int")
    missing = F.array_except(F.sequence(F.lit(0), expected - 1), F.col("have"))
    return found.select(problem, F.size("have").alias("available"), expected.alias("expected"), F.array_sort(missing).alias("missing"), (F.size(missing) == 0).alias("complete"))


def conflicts(rows: DataFrame, fields: Sequence[str], problem: str = "problem") -> DataFrame:
    """(problem, field) where the rows of a problem disagree in a field; null differs from a value."""
    apart = {f: F.count_distinct(F.struct(F.col(f))) > 1 for f in fields}
    found = rows.groupBy(problem).agg(F.filter(F.array(*[F.when(c, F.lit(f)) for f, c in apart.items()]), lambda x: x.isNotNull()).alias("fields"))
    return found.select(problem, F.explode("fields").alias("field"))


def in_sample_order(rows: DataFrame, problem: str = "problem", ordinal: str = "ordinal", index: str = "sample_index") -> DataFrame:
    """Gives each problem's samples, by index, that problem's ordinals, by size: file order with samples in order."""
    nth_index = F.row_number().over(Window.partitionBy(problem).orderBy(index))
    by = Window.partitionBy(problem)
    slots = F.array_sort(F.collect_list(ordinal).over(by))
    slots_, nth_ = fresh(rows.columns, "__slots", "__nth")
    return rows.withColumns({slots_: slots, nth_: nth_index}).withColumn(ordinal, F.element_at(slots_, F.col(nth_))).drop(slots_, nth_)


def normalize_samples(rows: DataFrame, fields: Sequence[str], problem: str = "problem", ordinal: str = "ordinal", index: str = "sample_index", n_samples: str = "n_samples") -> DataFrame:
    """Checked, numbered and ordered samples with a column complete. A conflict or fault fails the job and names the problem."""
    numbered = assign_sample_index(rows, problem, ordinal, index)
    by = Window.partitionBy(problem)
    apart = [F.size(F.collect_set(F.coalesce(F.to_json(F.struct(F.col(f))), F.lit("-"))).over(by)) > 1 for f in fields]
    given = F.collect_list(index).over(by)
    n = F.max(n_samples).over(by)
    checks = [
        *[(c, f"conflicting values of {f}") for f, c in zip(fields, apart)],
        (F.size(given) > F.size(F.array_distinct(given)), "duplicate sample index"),
        (F.array_min(given) < 0, "negative sample index"),
        (F.min(n_samples).over(by) < n, "conflicting sample counts"),
        (F.array_max(given) >= n, "sample index beyond the sample count"),
    ]
    expected = F.coalesce(n, F.array_max(given) + 1).cast("int")
    done = F.size(F.array_except(F.sequence(F.lit(0), expected - 1), F.array_distinct(given).cast("array<int>"))) == 0
    whole = done
    for bad, what in reversed(checks):
        whole = F.when(bad, F.raise_error(F.concat(F.lit(f"{what}: "), F.col(problem))).cast("boolean")).otherwise(whole)
    return in_sample_order(numbered.withColumn("complete", whole).withColumn(n_samples, expected), problem, ordinal, index)
