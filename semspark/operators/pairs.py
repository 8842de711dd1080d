"""Operators that ask a model about pairs of rows: joins by meaning, and orders by meaning."""

from __future__ import annotations


from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.names import fresh
from ..functions.numbering import numbered
from ..functions.skew import spread_join
from ..runtime.embedders import HashingEmbedder
from ..runtime.protocol import find_dict
from ..runtime.shared import few, written
from .base import answer_udf, col, dealt, input_columns, require_frame, serialised, shared_model
from .dedup import embed
from .graph import nearest_graph

ANSWER = "answer"
_VERDICT = T.StructType([T.StructField("yes", T.BooleanType()), T.StructField("error", T.StringType())])
#: Rows of a part whose best is taken as the next pivot while many more rows are left than are wanted.
SAMPLE = 8
#: Rows that are left to order at most when the driver does the rest, in packed calls of its own.
LAST = 2000


def _read_verdict(answer) -> dict:
    if isinstance(answer, Exception):
        return {"yes": None, "error": str(answer) or type(answer).__name__}
    try:
        value = {"true": True, "false": False}.get(str(find_dict(answer)[ANSWER]).strip().lower())
    except (ValueError, KeyError, RecursionError) as error:
        return {"yes": None, "error": f"unreadable: {error}"}
    return {"yes": value, "error": None if value is not None else f"{ANSWER} is not a truth value"}


def _verdicts(llm, tasks: int, pairs: DataFrame, first: str, second: str, question: str, max_retries: int) -> DataFrame:
    """``pairs`` with the columns ``yes`` and ``error``. first and second name columns of serialised rows."""
    text = F.concat(F.lit('{"first": '), F.col(first), F.lit(', "second": '), F.col(second), F.lit("}"))
    prefix = f"Each record is a pair of rows, first and second. Answer each with a dictionary of the key {ANSWER}, True or False.\n"
    ask = answer_udf(llm, prefix, f"Question: {question}", "\nAnswer all records.", _read_verdict, _VERDICT, max_retries)
    return dealt(pairs, tasks).withColumn("v", ask(text)).select(*pairs.columns, "v.yes", "v.error")


def _texts(df: DataFrame, fields: list[str], name: str) -> DataFrame:
    """Distinct serialised rows, with the text that is embedded for each: their values, as the sides' names differ."""
    rows = df.select(serialised(fields).alias("row"), F.concat_ws(" ", *[col(c).cast("string") for c in fields]).alias("words"))
    return rows.groupBy("row").agg(F.min("words").alias("words")).withColumn("side", F.lit(name))


def verified_pairs(llm, left: DataFrame, right: DataFrame, prompt: str, left_fields: list[str], right_fields: list[str], embedder=None, top_k: int = 20, threshold: float = 0.3, max_retries: int = 5, **graph) -> DataFrame:
    """(first, second): the pairs of distinct serialised inputs of which the model says that the condition holds.

    Candidates are, for each distinct left input, the ``top_k`` nearest right ones by the cosine of their vectors, of at
    least ``threshold``; only they are asked for, so calls grow with the distinct left inputs. A pair whose answer cannot
    be read is left out. Other arguments (m, ef, probes) are those of the neighbour graph.
    """
    llm, tasks = shared_model(left.sparkSession, llm)
    texts = written(_texts(left, left_fields, "left").union(_texts(right, right_fields, "right")), "texts")
    numbers = numbered(texts.select(F.concat("side", F.lit(":"), "row")))
    known = written(texts.join(numbers, F.concat("side", F.lit(":"), "row") == F.col("given")).select("number", "side", "row", "words"), "texts")
    vectors = written(embed(known, "number", F.col("words"), embedder or HashingEmbedder()).join(known.select(F.col("number").alias("id"), "side"), "id"), "vectors")
    # A condition on the side has to be one on (id, vec): the sign of the id tells the sides apart.
    signed = vectors.select(F.when(F.col("side") == "left", -F.col("id") - 1).otherwise(F.col("id")).alias("id"), "vec")
    near = written(nearest_graph(signed, top_k, threshold, asked=F.col("id") < 0, held=F.col("id") >= 0, **graph), "near")
    pairs = near.select((-F.col("id") - 1).alias("l"), F.col("hit").alias("r"))
    pairs = pairs.join(known.select(F.col("number").alias("l"), F.col("row").alias("first")), "l").join(known.select(F.col("number").alias("r"), F.col("row").alias("second")), "r")
    asked = written(_verdicts(llm, tasks, pairs.select("first", "second"), "first", "second", prompt, max_retries), "verdicts")
    return asked.where("yes").select("first", "second")


def sem_join(llm, left: DataFrame, right: DataFrame, *, prompt: str, left_fields=None, right_fields=None, how: str = "inner", suffix: str = "_right", **options) -> DataFrame:
    """Rows of ``left`` beside those of ``right`` for which the condition holds, say "the part is of the kind".

    Inputs are the named fields of each side, or all; equal inputs are compared once, whatever their rows' number. See
    ``verified_pairs`` for what is asked and the options. how: 'inner', 'left' (rows without a partner stay, with nulls),
    'left_semi' or 'left_anti'. Columns of the right that clash get the suffix. Very many rows may have one input.
    """
    require_frame(left)
    require_frame(right)
    if how not in ("inner", "left", "left_semi", "left_anti"):
        raise ValueError("how is 'inner', 'left', 'left_semi' or 'left_anti'")
    left_fields, right_fields = input_columns(left, left_fields), input_columns(right, right_fields)
    found = verified_pairs(llm, left, right, prompt, left_fields, right_fields, **options)
    first, second = fresh([*left.columns, *right.columns], "first_input", "second_input")
    keyed = left.withColumn(first, serialised(left_fields))
    if how in ("left_semi", "left_anti"):
        return spread_join(keyed, found.select(F.col("first").alias(first)).distinct(), [first], how).drop(first)
    names = [*left.columns, first, second]
    other = right.withColumn(second, serialised(right_fields))
    for column in right.columns:
        if column.lower() in {n.lower() for n in left.columns}:
            (new,) = fresh([*names, *[c for c in other.columns if c != column]], column + suffix)
            other = other.withColumnRenamed(column, new)
    paired = spread_join(keyed, found.toDF(first, second), [first], how)
    return spread_join(paired, other, [second], how, salts=8).drop(first, second)


def sem_top_k(llm, df: DataFrame, *, prompt: str, k: int, id_col: str, input_fields=None, max_retries: int = 5) -> DataFrame:
    """The first ``k`` rows of ``df`` in the order that the model's answers to "does the first rank before the second?"
    make, with their ``rank`` from 1; ``prompt`` says what ranks a row before another.

    A pivot splits the rows into those before and after it, all compared in one round of packed requests; parts that
    cannot hold one of the first ``k`` are dropped, and the others are split again. While many rows are left the pivot is
    the best of a few, so the rows asked for are little more than the rows there are; the last LAST are ordered on the
    driver in the same way. A model whose answers are an order
    gives exactly its first rows; ties have to be answered False both ways and are broken by ``id_col``, which is unique.
    Equal inputs are one, whatever their number. An answer that cannot be read counts as False. k is at least 1.
    """
    require_frame(df)
    if k < 1:
        raise ValueError("k is at least 1")
    fields = input_columns(df, input_fields)
    own, rank, key = fresh(df.columns, "input", "rank", "first")
    llm, tasks = shared_model(df.sparkSession, llm)
    keyed = df.withColumn(own, serialised(fields))
    rows = keyed.groupBy(F.col(own).alias("row")).agg(F.count("*").alias("n"))
    # low: rows known to rank before the part that a row is in
    open_ = written(rows.select("row", "n", F.lit(0).cast("long").alias("low")), "rows")
    settled = None
    turn = 0
    while True:
        parts = written(open_.groupBy("low").agg(F.count("*").alias("rows"), F.min(F.struct(F.xxhash64("row", F.lit(turn)), F.col("row"))).alias("p")).select("low", "rows", F.col("p.row").alias("pivot")), "parts")
        done = open_.join(few(parts.where("rows = 1")), "low", "left_semi").select("row", "low")
        settled = done if settled is None else settled.union(done)
        split = parts.where("rows > 1")
        left = split.agg(F.sum("rows")).first()[0] or 0
        if left <= LAST:
            held = open_.join(few(written(split.select("low"), "split")), "low", "left_semi").select("row", "n", "low").collect()
            ends = _ended(llm, [tuple(r) for r in held], k, prompt, max_retries)
            settled = settled.union(df.sparkSession.createDataFrame(ends, "row string, low long"))
            break
        first = parts.where(F.col("low") == 0).first()
        if first is not None and first["rows"] > 2 * SAMPLE * k:
            few_rows = open_.where("low = 0").orderBy(F.xxhash64("row", F.lit(turn)), "row").select("row").limit(SAMPLE).collect()
            best = _best(llm, [r.row for r in few_rows], prompt, max_retries)
            split = split.withColumn("pivot", F.when(F.col("low") == 0, F.lit(best)).otherwise(F.col("pivot")))
        dealt_rows = open_.join(few(written(split.select("low", "pivot"), "split")), "low")
        judged = written(_verdicts(llm, tasks, dealt_rows.where("row <> pivot"), "row", "pivot", prompt, max_retries).select("row", "n", "low", "pivot", F.coalesce("yes", F.lit(False)).alias("before")), "judged")
        pivots = split.join(open_.select(F.col("row").alias("pivot"), "n", F.col("low").alias("of")), "pivot").where("of = low").select("low", "pivot", "n")
        ahead = judged.groupBy("low").agg(F.coalesce(F.sum(F.when(F.col("before"), F.col("n"))), F.lit(0)).alias("ahead"))
        at = written(pivots.join(ahead, "low", "left").select("low", F.col("pivot").alias("row"), F.coalesce("ahead", F.lit(0)).alias("ahead"), "n"), "pivots")
        settled = settled.union(at.select("row", F.col("low") + F.col("ahead")))
        moved = judged.join(few(at.select("low", "ahead", F.col("n").alias("own"))), "low")
        moved = moved.select("row", "n", (F.col("low") + F.when(F.col("before"), 0).otherwise(F.col("ahead") + F.col("own"))).alias("low"))
        open_ = written(moved.where(F.col("low") < k), "rows")
        turn += 1
    best = written(settled.where(F.col("low") < k).toDF(key, rank), "ranks")  # k rows at most
    first_rows = keyed.join(F.broadcast(best), F.col(own) == F.col(key)).orderBy(rank, id_col).limit(k)
    return first_rows.withColumn(rank, F.row_number().over(Window.orderBy(rank, id_col))).select(*df.columns, rank)


def _asked(llm, pairs: list[tuple[str, str]], prompt: str, max_retries: int) -> list[bool]:
    """Whether the first ranks before the second, for each pair, in packed calls on the driver."""
    prefix = f"Each record is a pair of rows, first and second. Answer each with a dictionary of the key {ANSWER}, True or False.\n"
    asked = [f'{{"first": {a}, "second": {b}}}' for a, b in pairs]
    return [_read_verdict(v)["yes"] is True for v in llm.runner().run(asked, prefix, f"Question: {prompt}", "\nAnswer all records.", max_retries)]


def _ended(llm, rows: list[tuple[str, int, int]], k: int, prompt: str, max_retries: int) -> list[tuple[str, int]]:
    """(row, rows before it) of the rows (row, n, low) of parts that are split until each has one, all parts at once."""
    parts: dict[int, list[tuple[str, int]]] = {}
    for row, n, low in rows:
        parts.setdefault(low, []).append((row, n))
    out = []
    while parts:
        pivots = {low: own[len(own) // 2] for low, own in parts.items()}
        pairs = [(low, r) for low, own in parts.items() for r in own if r is not pivots[low]]
        answers = _asked(llm, [(r[0], pivots[low][0]) for low, r in pairs], prompt, max_retries) if pairs else []
        before: dict[int, list] = {low: [] for low in parts}
        after: dict[int, list] = {low: [] for low in parts}
        for (low, r), yes in zip(pairs, answers, strict=True):
            (before if yes else after)[low].append(r)
        parts = {}
        for low, pivot in pivots.items():
            at = low + sum(n for _, n in before[low])
            out.append((pivot[0], at))
            for begin, own in ((low, before[low]), (at + pivot[1], after[low])):
                if own and begin < k:
                    parts[begin] = own
    return out


def _best(llm, rows: list[str], prompt: str, max_retries: int) -> str:
    """The first of a few rows: rounds of a knock-out."""
    while len(rows) > 1:
        pairs = [(rows[i], rows[i + 1]) for i in range(0, len(rows) - 1, 2)]
        answers = _asked(llm, pairs, prompt, max_retries)
        rows = [a if yes else b for (a, b), yes in zip(pairs, answers, strict=True)] + rows[len(pairs) * 2 :]
    return rows[0]
