"""Budgets: what fits, in order. Both folds depend on every earlier decision, so rows pass the driver in order, a bounded
chunk at a time, with numbers and paths alone; decisions go back as tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import Config
from ..session import cut, shared_dir

CHUNK = 100_000


def wants_content(rows: DataFrame, config: Config = Config(), only_tree: bool = False) -> DataFrame:
    """Add ``wanted`` and, where not, ``omitted_reason``, before any budget. Rows have kind, score, content_policy,
    size_bytes, is_binary and is_seed."""
    m, c = config.modules_config, config.content
    kind = F.col("kind")
    reason = (
        F.when(F.lit(only_tree), "only-tree mode").when(F.col("is_binary"), "binary file").when(F.col("is_seed"), None)
        .when((kind == "code") & (F.col("score") < m.content_min_score), f"score below content_min_score={m.content_min_score}")
        .when((kind == "support") & (F.col("content_policy") == "tree_only"), "support content policy: tree_only")
        .when((kind == "support") & (F.col("content_policy") == "auto") & (F.col("size_bytes") > c.auto_max_bytes), f"support file larger than auto_max_bytes={c.auto_max_bytes}")
        .when(~kind.isin("code", "support"), "other file not selected for content")
    )
    return rows.withColumn("omitted_reason", reason).withColumn("wanted", F.col("omitted_reason").isNull())


def greedy(rows: DataFrame, budget: int, tokens: str = "tokens", rank: str = "rank", free: str | None = None, chunk: int = CHUNK) -> DataFrame:
    """Add ``included``: by rank, a row is taken if it fits what is left, else skipped and the next tried. Rows where
    ``free`` holds are taken and use nothing. A budget of 0 or less is none: all are taken.

    Only rows that could still fit are read: each round takes the next ``chunk`` rows by rank among those of at most what
    is left. Each taken row of a token or more uses some, so the budget bounds what is kept here; rows without
    tokens always fit and never come here.
    """
    gratis = (F.col(free) if free else F.lit(False)) | (F.col(tokens) <= 0)
    if budget <= 0:
        return rows.withColumn("included", F.lit(True))
    spark = rows.sparkSession
    small = cut(rows.where(~gratis & (F.col(tokens) <= budget)).select(F.col(rank).alias("r"), F.col(tokens).alias("t")), "greedy")
    left, last, taken = budget, None, []
    while left > 0:
        part = small.where((F.col("t") <= left) & (F.lit(True) if last is None else F.col("r") > last)).orderBy("r").limit(chunk).collect()
        for row in part:
            if row.t <= left:
                left -= row.t
                taken.append((row.r,))
            last = row.r
        if len(part) < chunk:
            break
    kept = spark.createDataFrame(taken, f"{rank} long").withColumn("taken", F.lit(True))
    return rows.join(kept, rank, "left").withColumn("included", gratis | F.coalesce("taken", F.lit(False))).drop("taken")


def fold(rows: DataFrame, order: list, columns: list[str], step: Callable, state, out: str, chunk: int = CHUNK) -> DataFrame:
    """Run ``step(state, row) -> (state, tuple)`` over all rows in order and return the tuples as a table ``out`` (a schema).

    The rows are sorted once by the cluster and streamed; every ``chunk`` results are written to the shared folder, so
    the driver holds one chunk and the state, whatever the number of rows.
    """
    import uuid

    spark = rows.sparkSession
    path = f"{shared_dir(spark)}/fold-{uuid.uuid4().hex}"
    ordered = cut(rows.orderBy(*order).select(*columns, F.monotonically_increasing_id().alias("_n")), "fold").orderBy("_n")
    done, wrote = [], False

    def flush():
        nonlocal done, wrote
        spark.createDataFrame(done, out).coalesce(1).write.mode("append").parquet(path)
        done, wrote = [], True

    for row in ordered.toLocalIterator(prefetchPartitions=True):
        state, result = step(state, row)
        done.append(result)
        if len(done) >= chunk:
            flush()
    if done or not wrote:
        flush()
    return spark.read.schema(out).parquet(path)


WEIGHTS = dict(zip("full excerpt outline tree omit".split(), (1.0, 0.25, 0.12, 0.02, 0.0)))
TARGET, HARD = 30_000, 100_000


def mode_of(current: int, row, target: int, hard: int, focused: bool) -> tuple[int, str]:
    """The mode of the next item and the cost so far with it."""
    t, score = row.token_estimate, row.score
    cost = {m: int(t * w) for m, w in WEIGHTS.items()}
    fits = lambda m: current + cost[m] <= hard
    if row.is_seed:
        mode = "full"
    elif row.content_policy == "tree_only":
        mode = "tree"
    elif row.content_policy == "full" and not focused:
        mode = "full"
    elif t <= 1200 and score >= 80 and fits("full") or score >= 85 and t <= 2400 and fits("full") and current < int(0.85 * target):
        mode = "full"
    elif score >= 75 and fits("excerpt"):
        mode = "excerpt"
    else:
        mode = "outline" if fits("outline") else "tree"
    return current + cost[mode], mode


def modes(rows: DataFrame, order: list, max_tokens: int = 0, focused: bool = True) -> DataFrame:
    """(path, item_id, content_mode, spent): the mode ladder by rank; ``spent`` is the running cost after the item. Rows
    have path, score, token_estimate, content_policy and is_seed."""
    target, hard = max_tokens or TARGET, max_tokens or HARD

    def step(state, row):
        n, current = state
        current, mode = mode_of(current, row, target, hard, focused)
        return (n + 1, current), (row.path, f"F{n + 1:03d}", mode, current)

    return fold(rows, order, ["path", "score", "token_estimate", "content_policy", "is_seed"], step, (0, 0), "path string, item_id string, content_mode string, spent long")


def settle(rows: DataFrame, order: list, target: int) -> DataFrame:
    """(path, content_mode, tokens, actual): the second fold. Full items count their tokens; an excerpt or outline its outline's;
    an excerpt without symbols becomes full if it fits the target, else tree. Rows have path, content_mode, token_estimate,
    outline_tokens and n_symbols."""

    def step(actual, row):
        mode, used = row.content_mode, 0
        if mode == "full":
            used = row.token_estimate
        elif mode == "excerpt" and not row.n_symbols:
            mode, used = ("full", row.token_estimate) if actual + row.token_estimate <= target else ("tree", 0)
        elif mode in ("excerpt", "outline"):
            used = row.outline_tokens
        return actual + used, (row.path, mode, used, actual + used)

    return fold(rows, order, ["path", "content_mode", "token_estimate", "outline_tokens", "n_symbols"], step, 0, "path string, content_mode string, tokens long, actual long")
