"""Semantic map and filter: a language model derives columns from rows, or keeps and drops rows."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.names import fresh
from ..functions.skew import spread_join
from ..functions.types import ddl_of
from ..runtime.protocol import find_dict
from ..runtime.shared import written
from ..runtime.store import content_key
from .base import DELETED, ERROR, INTERNAL, Op, answer_udf, col, dealt, flag, input_columns, require_frame, serialised, shared_model

FILTER_KEY = "__filter__"
_MAP_ANSWER = T.StructType([T.StructField("raw", T.StringType()), T.StructField("error", T.StringType()), T.StructField("fields", T.StringType())])
_FILTER_ANSWER = T.StructType([T.StructField("raw", T.StringType()), T.StructField("error", T.StringType()), T.StructField("keep", T.BooleanType())])


def _read_map(answer) -> dict:
    if isinstance(answer, Exception):
        return {"raw": None, "error": str(answer) or type(answer).__name__, "fields": None}
    try:
        return {"raw": answer, "error": None, "fields": json.dumps(find_dict(answer), default=str)}
    except (ValueError, RecursionError) as error:
        return {"raw": answer, "error": f"unreadable: {error}", "fields": None}


def _read_filter(answer) -> dict:
    if isinstance(answer, Exception):
        return {"raw": None, "error": str(answer) or type(answer).__name__, "keep": None}
    try:
        value = find_dict(answer)[FILTER_KEY]
    except (ValueError, KeyError, RecursionError) as error:
        return {"raw": answer, "error": f"unreadable: {error}", "keep": None}
    value = {"true": True, "false": False}.get(str(value).strip().lower())
    return {"raw": answer, "error": None if value is not None else f"{FILTER_KEY} is not a truth value", "keep": value}


def _output_types(fields) -> dict[str, str]:
    if fields is None:
        return {}
    if isinstance(fields, T.StructType):
        return {f.name: f.dataType.simpleString() for f in fields.fields}
    if isinstance(fields, dict):
        return {k: ddl_of(v) for k, v in fields.items()}
    return dict.fromkeys(fields, "string")


def cluster_map(df: DataFrame, clusters) -> DataFrame:
    """(dup, canonical) from merges (canonical_id, duplicate_ids), pairs (id, canonical_id) or a list of {canonical_id,
    duplicate_ids}; a duplicate has one canonical."""
    if not isinstance(clusters, DataFrame):
        rows = [(c["canonical_id"], list(c["duplicate_ids"])) for c in clusters]
        clusters = df.sparkSession.createDataFrame(rows, "canonical_id long, duplicate_ids array<long>")
    dup = F.explode("duplicate_ids") if "duplicate_ids" in clusters.columns else F.col("id")
    pairs = clusters.select(F.col("canonical_id").alias("canonical"), dup.alias("dup"))
    return pairs.where("dup <> canonical").groupBy("dup").agg(F.min("canonical").alias("canonical"))


class _Semantic(Op):
    def __init__(self, prompt: str, input_fields=None, name=None, clusters=None, id_col=None, collapse: bool = False, max_retries: int = 5, store=None):
        super().__init__(name)
        if clusters is not None and id_col is None:
            raise ValueError("clusters need id_col, the column that their ids are from")
        self.prompt, self.input_fields, self.clusters, self.id_col, self.collapse, self.max_retries = prompt, input_fields, clusters, id_col, collapse, max_retries
        self.store = store
        self.input, self.output = f"{INTERNAL}{self.name}_input", f"{INTERNAL}{self.name}_output"

    def _answered(self, llm, df: DataFrame, question) -> DataFrame:
        """``df`` with the serialised input and the struct of answers. Deleted rows are not sent.

        Helper columns get names that clash with none of ``df``. question: a model to the UDF that asks it.
        """
        llm, tasks = shared_model(df.sparkSession, llm)
        ask = question(llm)
        self._model = f"{llm.model_name}/{llm.temperature}"
        text = serialised(input_columns(df, self.input_fields))
        rows = df.withColumn(self.input, F.when(~flag(df, DELETED), text))
        if self.clusters is None:
            return self._ask(rows, ask, tasks)
        canonical, dup, key, given = fresh([*rows.columns, self.output], "canonical", "dup", "of_canonical", "given")
        pairs = cluster_map(df, self.clusters).toDF(dup, canonical)
        rows = rows.join(pairs, col(self.id_col) == F.col(dup), "left").drop(dup)
        # Used twice below, so the answers are made once and kept.
        asked = written(self._ask(rows.withColumn(self.input, F.when(F.col(canonical).isNull(), F.col(self.input))), ask, tasks), "answers")
        known = asked.where(F.col(canonical).isNull()).select(col(self.id_col).alias(key), F.col(self.output).alias(given)).dropDuplicates([key])
        out = asked.join(known, F.col(canonical) == F.col(key), "left")
        out = out.withColumn(self.output, F.when(F.col(canonical).isNull() | flag(df, DELETED), F.col(self.output)).otherwise(F.col(given)))
        return out.withColumn(self.input, F.when(~flag(df, DELETED), text)).drop(canonical, key, given)

    def _question(self) -> str:
        """What is asked of each row; answers are stored under it."""
        return f"{type(self).__name__}: {self.prompt}"

    def _stored(self, rows: DataFrame, ask, tasks: int) -> DataFrame:
        """As ``_ask`` with ``collapse``, but only what the store lacks is sent. Readable answers are stored; the others
        are sent again by the next run. Runs a job."""
        sent, given = fresh([*rows.columns, self.output, "key", "text", "value"], "sent", "given")
        inputs = written(rows.select(F.col(self.input).alias("text")).where("text is not null").distinct(), "inputs")
        keyed = inputs.select(content_key(self._model, F.lit(self._question()), F.col("text")).alias("key"), "text")
        lacking = written(self.store.missing(keyed), "missing")
        failed = None
        if not lacking.isEmpty():
            asked = written(dealt(lacking, tasks).withColumn(given, ask(F.col("text"))), "answers")
            readable = F.col(given)["error"].isNull()
            self.store.append(asked.where(readable).select("key", F.to_json(given, {"ignoreNullFields": "false"}).alias("value")))
            failed = asked.where(~readable).select("text", given)
        schema = lacking.withColumn(given, ask(F.col("text"))).schema[given].dataType
        known = self.store.known(keyed).where("value is not null").select("text", F.from_json("value", schema).alias(given))
        known = written(known if failed is None else known.unionByName(failed), "given").toDF(sent, self.output)
        dealt_rows = rows.withColumn(sent, F.col(self.input))
        return spread_join(dealt_rows, known, [sent], "left").drop(sent)

    def _ask(self, rows: DataFrame, ask, tasks: int) -> DataFrame:
        if self.store is not None:
            return self._stored(rows, ask, tasks)
        if not self.collapse:
            return dealt(rows, tasks).withColumn(self.output, ask(F.col(self.input)))
        (sent,) = fresh([*rows.columns, self.output], "sent")
        distinct = rows.select(F.col(self.input).alias(sent)).where(F.col(sent).isNotNull()).distinct()
        given = dealt(distinct, tasks).withColumn(self.output, ask(F.col(sent)))
        return rows.join(given, F.col(self.input) == F.col(sent), "left").drop(sent)


class SemanticMap(_Semantic):
    """Columns from a prompt. See ``map``."""

    def __init__(self, prompt: str, output_fields=None, **options):
        super().__init__(prompt, **options)
        self.types = _output_types(output_fields)

    def _question(self) -> str:
        return f"{super()._question()} -> {sorted(self.types)}"

    def __call__(self, llm, df: DataFrame) -> DataFrame:
        require_frame(df)
        names = list(self.types) or [c for c in df.columns if not c.startswith(INTERNAL)]
        wanted = f"the keys {', '.join(names)}" if self.types else "the fields to change"
        question = lambda llm: answer_udf(llm, f"Change each record as the task says and answer with a dictionary of {wanted}.\n", f"Task: {self.prompt}", "\nAnswer all records.", _read_map, _MAP_ANSWER, self.max_retries)
        out = self._answered(llm, df, question)
        found = F.from_json(F.col(self.output)["fields"], "map<string,string>")
        known = {f.name: f.dataType.simpleString() for f in df.schema.fields}
        values: dict[str, Column] = {}
        failed = F.col(self.output)["error"].isNotNull()
        for name in names:
            kind = self.types.get(name, known.get(name, "string")) if name not in known else known[name]
            text = found[name]
            # Structures are read from their JSON; all else is cast. What does not fit leaves the old value.
            value = F.from_json(text, kind) if kind.startswith(("array", "map", "struct")) else text.try_cast(kind)
            misfit = text.isNotNull() & value.isNull()
            given = F.coalesce(F.map_contains_key(found, F.lit(name)), F.lit(False))
            values[name] = F.when(given & ~misfit, value).otherwise(col(name) if name in known else F.lit(None).cast(kind))
            failed = failed | F.coalesce(misfit, F.lit(False))
        values[ERROR] = flag(df, ERROR) | failed
        out = out.withColumns(values)
        return out.withColumn(self.output, F.col(self.output)["raw"])


class SemanticFilter(_Semantic):
    """Marks rows to keep or drop from a prompt. See ``filter``."""

    def __init__(self, prompt: str, on_error: str = "keep", **options):
        super().__init__(prompt, **options)
        if on_error not in ("keep", "delete"):
            raise ValueError("on_error is 'keep' or 'delete'")
        self.on_error, self.result = on_error, f"{INTERNAL}{self.name}_result"

    def __call__(self, llm, df: DataFrame) -> DataFrame:
        require_frame(df)
        question = lambda llm: answer_udf(llm, f"Decide for each record whether the condition holds and answer with the record's dictionary and a key {FILTER_KEY} that is True or False.\n", f"Condition: {self.prompt}", "\nAnswer all records.", _read_filter, _FILTER_ANSWER, self.max_retries)
        out = self._answered(llm, df, question)
        asked = ~flag(df, DELETED)
        keep = F.col(self.output)["keep"]
        result = F.when(keep, 1).when(~keep, 0).when(asked, -1).cast("int")
        drop = (result == 0) | ((result == -1) & F.lit(self.on_error == "delete"))
        out = out.withColumns({self.result: result, DELETED: flag(df, DELETED) | F.coalesce(drop, F.lit(False)), ERROR: flag(df, ERROR) | F.coalesce(result == -1, F.lit(False))})
        return out.withColumn(self.output, F.col(self.output)["raw"])


def map(*, prompt: str, output_fields=None, input_fields=None, name=None, clusters=None, id_col=None, collapse=False, max_retries=5, store=None) -> SemanticMap:  # noqa: A001
    """A semantic projection, used as ``map(prompt=...)(llm, df)``.

    output_fields: names (text), a dict of name to type, or a StructType; without it only existing columns may change.
    A key that the answer lacks leaves an existing column as it is, a null sets it to null. A row whose answer cannot
    be read or does not fit its type is flagged in ``__sem_error`` and keeps its values. clusters (with id_col): rows
    named as duplicates are not sent and take their canonical row's answer. collapse: equal inputs are sent once.
    store (an AnswerStore): readable answers are kept by model, question and input, and what it has is not sent again.
    """
    return SemanticMap(prompt, output_fields, input_fields=input_fields, name=name, clusters=clusters, id_col=id_col, collapse=collapse, max_retries=max_retries, store=store)


def filter(*, prompt: str, input_fields=None, name=None, clusters=None, id_col=None, on_error="keep", collapse=False, max_retries=5, store=None) -> SemanticFilter:  # noqa: A001
    """A semantic predicate, used as ``filter(prompt=...)(llm, df)``: rows are marked, ``finalize`` removes them.

    The result column holds 1, 0 or -1 (no usable answer). Rows with -1 are flagged and stay, or go with
    ``on_error='delete'``. Rows that an earlier filter dropped are not sent and stay dropped.
    """
    return SemanticFilter(prompt, on_error, input_fields=input_fields, name=name, clusters=clusters, id_col=id_col, collapse=collapse, max_retries=max_retries, store=store)


def finalize(df: DataFrame, keep_errored_rows: bool = False) -> DataFrame:
    """``df`` without dropped rows and without bookkeeping columns.

    Flagged rows that were not dropped stay. ``keep_errored_rows`` keeps also those that went for their error alone.
    """
    require_frame(df)
    if DELETED in df.columns:
        gone = flag(df, DELETED)
        if keep_errored_rows:
            for c in [c for c in df.columns if c.startswith(INTERNAL) and c.endswith("_result")]:
                gone = gone & ~F.coalesce(col(c) == -1, F.lit(False))
        df = df.where(~gone)
    return df.drop(*[c for c in df.columns if c.startswith(INTERNAL)])
