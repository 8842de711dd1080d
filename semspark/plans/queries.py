"""The registered queries of the semantic engine, each beside the SQL that gives the same rows."""

from __future__ import annotations

import json

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..agent import Agent, StepCounts, register_function, register_table_function, run_plan
from ..operators.dedup import SemanticDeduplicator, one_of_each, similar_pairs
from ..operators.graph import nearest_exact, nearest_graph, recall
from ..operators.groups import discover_labels, sem_agg, sem_group_by
from ..operators.pairs import sem_join, sem_top_k
from ..operators.reduce import reduce
from ..operators.semantic import filter as sem_filter
from ..operators.semantic import finalize
from ..operators.semantic import map as sem_map
from ..runtime.clients import CallableLLM, ScriptedLLM
from ..runtime.embedders import HashingEmbedder
from ..runtime.metrics import RunMetrics
from ..runtime.protocol import END, framed_rows
from ..runtime.shared import new_path, written
from ..runtime.store import AnswerStore, VectorStore
from . import rules, source_queries  # noqa: F401  registers its queries
from .registry import ORACLE_SQL, QUERIES
from .registry import query as _query
from .registry import table as _table

__all__ = ["ORACLE_SQL", "QUERIES"]


class FlakyLLM(CallableLLM):
    """Garbles the answer of every third row the first time that a worker sees it."""

    _seen: set[str] = set()

    def complete(self, prompt: str) -> str:
        out = []
        for index, row in framed_rows(prompt):
            first = row not in FlakyLLM._seen
            FlakyLLM._seen.add(row)
            out.append(f"index={index}|{'oops {' if first and index % 3 == 0 else repr(self.rule(row))}{END}")
        return "".join(out)


EVENT = "event_id, user_id, event_type, value"


def _events(spark, d):
    return _table(spark, d, "events").select("event_id", "user_id", "event_type", "value")


@_query(f"SELECT {EVENT} FROM events WHERE event_type IN ('purchase', 'signup')")
def sem_filter_keep(spark, d):
    return finalize(sem_filter(prompt="bought or signed up", input_fields=["event_type"])(CallableLLM(rules.wanted_event), _events(spark, d)))


@_query(f"SELECT {EVENT} FROM events WHERE event_type IN ('purchase', 'signup') OR event_id % 10 = 3")
def sem_filter_on_error_keep(spark, d):
    return finalize(sem_filter(prompt="bought or signed up", max_retries=1)(CallableLLM(rules.wanted_event_or_error), _events(spark, d)))


@_query(f"SELECT {EVENT} FROM events WHERE event_type IN ('purchase', 'signup') AND event_id % 10 <> 3")
def sem_filter_on_error_delete(spark, d):
    return finalize(sem_filter(prompt="bought or signed up", on_error="delete", max_retries=1)(CallableLLM(rules.wanted_event_or_error), _events(spark, d)))


@_query("SELECT event_id, CASE WHEN event_id % 10 = 3 THEN -1 WHEN event_type IN ('purchase', 'signup') THEN 1 ELSE 0 END AS result, event_id % 10 = 3 AS errored, event_id % 10 <> 3 AND event_type NOT IN ('purchase', 'signup') AS deleted FROM events")
def sem_filter_flags(spark, d):
    out = sem_filter(prompt="bought or signed up", name="q", max_retries=1)(CallableLLM(rules.wanted_event_or_error), _events(spark, d))
    return out.select("event_id", F.col("__sem_q_result").alias("result"), F.col("__sem_error").alias("errored"), F.col("__sem_deleted").alias("deleted"))


@_query("SELECT p_partkey, p_type FROM part WHERE length(p_type) % 2 = 0")
def sem_filter_input_fields(spark, d):
    return finalize(sem_filter(prompt="is of metal", input_fields=["p_type"])(CallableLLM(rules.metal_part), _table(spark, d, "part"))).select("p_partkey", "p_type")


@_query("SELECT c_custkey, c_name FROM customer WHERE c_mktsegment = 'MACHINERY' AND c_acctbal > 0")
def sem_filter_chain(spark, d):
    df = sem_filter(prompt="makes machines")(CallableLLM(rules.machinery_customer), _table(spark, d, "customer"))
    return finalize(sem_filter(prompt="has money")(CallableLLM(rules.rich_customer), df)).select("c_custkey", "c_name")


@_query("SELECT p_partkey, p_name, split_part(p_name, ' ', 1) AS adjective, split_part(p_name, ' ', 2) AS noun FROM part")
def sem_map_new_fields(spark, d):
    df = _table(spark, d, "part").select("p_partkey", "p_name")
    return finalize(sem_map(prompt="split the name", input_fields=["p_name"], output_fields=["adjective", "noun"])(CallableLLM(rules.part_words), df))


@_query("SELECT c_custkey, length(c_name)::INT AS name_length FROM customer")
def sem_map_typed_fields(spark, d):
    df = _table(spark, d, "customer").select("c_custkey", "c_name")
    return finalize(sem_map(prompt="measure the name", output_fields={"name_length": "int"})(CallableLLM(rules.name_length), df)).drop("c_name")


@_query("SELECT c_custkey, 'XX' AS c_name, c_mktsegment FROM customer")
def sem_map_overwrite(spark, d):
    df = _table(spark, d, "customer").select("c_custkey", "c_name", "c_mktsegment")
    return finalize(sem_map(prompt="mask the name")(CallableLLM(rules.mask_name), df))


@_query("SELECT event_id, CASE WHEN event_id % 3 = 1 THEN NULL ELSE event_type END AS event_type, CASE event_id % 3 WHEN 0 THEN upper(event_type) WHEN 1 THEN 'other' END AS note FROM events")
def sem_map_missing_keys(spark, d):
    df = _table(spark, d, "events").select("event_id", "event_type")
    return finalize(sem_map(prompt="note", output_fields=["event_type", "note"])(CallableLLM(rules.event_note), df))


@_query("SELECT event_id, CASE WHEN event_id % 7 <> 2 THEN upper(event_type) END AS note, event_id % 7 = 2 AS errored FROM events")
def sem_map_error_flag(spark, d):
    df = _table(spark, d, "events").select("event_id", "event_type")
    out = sem_map(prompt="note", output_fields=["note"], max_retries=1)(CallableLLM(rules.event_note_or_error), df)
    return out.select("event_id", "note", F.col("__sem_error").alias("errored"))


@_query("SELECT p_partkey, p_type, split_part(p_name, ' ', 1) AS adjective, split_part(p_name, ' ', 2) AS noun FROM part WHERE length(p_type) % 2 = 0")
def sem_map_then_filter(spark, d):
    df = _table(spark, d, "part").select("p_partkey", "p_name", "p_type")
    df = sem_map(prompt="split the name", output_fields=["adjective", "noun"])(CallableLLM(rules.part_words), df)
    return finalize(sem_filter(prompt="is of metal")(CallableLLM(rules.metal_part), df)).drop("p_name")


@_query("SELECT o_orderkey, CAST(left(o_orderpriority, 1) AS INT) AS rank FROM orders")
def sem_map_retry(spark, d):
    df = _table(spark, d, "orders").select("o_orderkey", "o_orderpriority")
    return finalize(sem_map(prompt="rank", output_fields={"rank": "int"})(FlakyLLM(rules.order_rank), df)).select("o_orderkey", "rank")


@_query("SELECT o_orderkey, CAST(left(o_orderpriority, 1) AS INT) AS rank FROM orders")
def sem_map_distinct_collapse(spark, d):
    df = _table(spark, d, "orders").select("o_orderkey", "o_orderpriority")
    op = sem_map(prompt="rank", input_fields=["o_orderpriority"], output_fields={"rank": "int"}, collapse=True)
    return finalize(op(CallableLLM(rules.order_rank), df)).select("o_orderkey", "rank")


def _copies(df: DataFrame) -> DataFrame:
    return one_of_each(df.select(F.col("doc_id").alias("id"), F.md5("text").alias("h")), "h")[1]


@_query("SELECT doc_id, length(text)::BIGINT AS text_length FROM documents")
def sem_map_clusters(spark, d):
    df = _table(spark, d, "documents").select("doc_id", "text")
    op = sem_map(prompt="measure", input_fields=["text"], output_fields={"text_length": "bigint"}, clusters=_copies(df), id_col="doc_id")
    return finalize(op(CallableLLM(rules.text_length), df)).drop("text")


@_query("SELECT doc_id FROM documents WHERE length(text) > 1500")
def sem_filter_clusters(spark, d):
    df = _table(spark, d, "documents").select("doc_id", "text")
    op = sem_filter(prompt="is long", input_fields=["text"], clusters=_copies(df), id_col="doc_id")
    return finalize(op(CallableLLM(rules.long_text), df)).select("doc_id")


def _dedup(spark, d, return_df: bool):
    df = _table(spark, d, "documents").select("doc_id", "text", "lang")
    return reduce(df, action="dedup", llm=CallableLLM(rules.same_text), id_col="doc_id", input_fields=["text"], sim_threshold=0.9999, top_k=50, return_df=return_df, index="banded", recall=0.999)


@_query("SELECT min(doc_id) AS canonical_id, count(*) - 1 AS n_duplicates, sum(doc_id)::BIGINT - min(doc_id) AS sum_of_ids FROM documents GROUP BY text HAVING count(*) > 1")
def dedup_merges(spark, d):
    merges = _dedup(spark, d, False)
    return merges.select("canonical_id", F.size("duplicate_ids").cast("long").alias("n_duplicates"), F.aggregate("duplicate_ids", F.lit(0).cast("long"), lambda a, b: a + b).alias("sum_of_ids"))


@_query("SELECT doc_id, lang FROM documents QUALIFY row_number() OVER (PARTITION BY text ORDER BY doc_id) = 1")
def dedup_return_df(spark, d):
    return _dedup(spark, d, True).select("doc_id", "lang")


@_query("SELECT canonical_id, count(*) AS n_duplicates, min(id) AS first_duplicate FROM (SELECT 'doc-' || doc_id AS id, min('doc-' || doc_id) OVER (PARTITION BY text) AS canonical_id FROM documents) WHERE id <> canonical_id GROUP BY canonical_id")
def dedup_text_ids(spark, d):
    """Pairs of a frame whose ids are texts, in text order."""
    df = _table(spark, d, "documents").select(F.concat(F.lit("doc-"), "doc_id").alias("key"), "text")
    pairs = reduce(df, action="dedup", llm=CallableLLM(rules.same_text), id_col="key", input_fields=["text"], sim_threshold=0.9999, index="banded", recall=0.999, pairs=True)
    return pairs.groupBy("canonical_id").agg(F.count("*").alias("n_duplicates"), F.min("id").alias("first_duplicate"))


@_query("SELECT count(*) FILTER (vec_id % 20 = 0) AS n_asked, 10 * count(*) FILTER (vec_id % 20 = 0) AS n_hits, TRUE AS recall_reached FROM embeddings")
def knn_graph(spark, d):
    """Ten neighbours of each vector whose id 20 divides, by small-world graphs over all vectors: how many hits there
    are, and whether nine in ten of the exact ones are among them."""
    norm = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x * x))
    vectors = _table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.transform("embedding", lambda x: (x / norm).cast("float")).alias("vec"))
    asked = F.col("id") % 20 == 0
    found = written(nearest_graph(vectors, 10, -2.0, m=16, ef=96, asked=asked, recall=0.9), "found")
    reached = recall(found, nearest_exact(vectors, asked, 10)) >= 0.9
    return found.agg(F.countDistinct("id").alias("n_asked"), F.count("*").alias("n_hits"), F.lit(reached).alias("recall_reached"))


@_query("SELECT count(*) AS n_vectors, max(n) > 1 AS some_equal, 0 AS second_requests FROM (SELECT text, count(*) AS n FROM documents GROUP BY text)")
def embed_store(spark, d):
    """Vectors of all distinct texts, asked for twice: the second run sends no request."""
    metrics, store = RunMetrics(spark), VectorStore(new_path(spark, "vector-store"))
    docs = _table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text")
    embedder = HashingEmbedder(64, metrics)
    first = store.embedded(docs, embedder)
    sent = metrics.values()["embedding_requests"]
    again = store.embedded(docs, embedder)
    both = first.select("id", F.xxhash64("vec").alias("first")).join(again.select("id", F.xxhash64("vec").alias("v")), "id").where("first = v")
    texts = docs.select("id", F.md5("text").alias("t")).join(both, "id").groupBy("t").agg(F.countDistinct("v").alias("vectors"), F.count("*").alias("n"))
    return texts.agg(F.sum("vectors").alias("n_vectors"), F.coalesce(F.max("n") > 1, F.lit(False)).alias("some_equal"), F.lit(metrics.values()["embedding_requests"] - sent).alias("second_requests"))


@_query("SELECT o_orderkey, CAST(left(o_orderpriority, 1) AS INT) AS rank, 0 AS rows_sent_again FROM orders")
def sem_map_stored(spark, d):
    """A map whose answers are stored: the second run sends no row."""
    metrics, store = RunMetrics(spark), AnswerStore(new_path(spark, "answer-store"))
    df = _table(spark, d, "orders").select("o_orderkey", "o_orderpriority")
    op = sem_map(prompt="rank", input_fields=["o_orderpriority"], output_fields={"rank": "int"}, store=store)
    llm = CallableLLM(rules.order_rank, metrics=metrics)
    op(llm, df)
    sent = metrics.values()["rows"]
    again = finalize(op(llm, df)).select("o_orderkey", "rank")
    return again.withColumn("rows_sent_again", F.lit(metrics.values()["rows"] - sent))


@_query("SELECT a.vec_id AS a, b.vec_id AS b, round(list_cosine_similarity(a.embedding, b.embedding)::DOUBLE, 4) AS score FROM embeddings a JOIN embeddings b ON a.vec_id < b.vec_id WHERE list_cosine_similarity(a.embedding, b.embedding) >= 0.42")
def knn_pairs(spark, d):
    vectors = _table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"))
    return similar_pairs(vectors, 0.42).select("a", "b", F.round(F.col("score").cast("double"), 4).alias("score"))


@_query("SELECT p_partkey, p_size, split_part(p_name, ' ', 2) AS kind FROM part")
def sem_join_parts(spark, d):
    """Parts beside their kinds, by a model that is asked about near pairs of names and kinds only."""
    parts = _table(spark, d, "part").select("p_partkey", "p_size", "p_name")
    kinds = parts.select(F.split_part("p_name", F.lit(" "), F.lit(2)).alias("kind")).distinct()
    joined = sem_join(CallableLLM(rules.part_is_of_kind), parts, kinds, prompt="is the first, a part, of the second, a kind?", left_fields=["p_name"], top_k=5)
    return joined.select("p_partkey", "p_size", "kind")


@_query("SELECT c_custkey, c_mktsegment FROM customer WHERE c_mktsegment NOT IN (SELECT c_mktsegment FROM customer WHERE c_custkey < 20 AND c_mktsegment LIKE '%E%')")
def sem_join_anti(spark, d):
    """Customers of segments that none of a few customers has, by meaning."""
    customers = _table(spark, d, "customer").select("c_custkey", "c_mktsegment")
    other = customers.where("c_custkey < 20 and c_mktsegment like '%E%'").select(F.lower("c_mktsegment").alias("segment"))
    return sem_join(CallableLLM(rules.same_segment), customers, other, prompt="do both name one segment?", left_fields=["c_mktsegment"], how="left_anti")


@_query("SELECT o_orderkey, o_totalprice, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey)::INT AS rank FROM orders QUALIFY rank <= 15")
def sem_top_orders(spark, d):
    """The fifteen dearest orders, by answers about pairs."""
    orders = _table(spark, d, "orders").select("o_orderkey", "o_totalprice")
    return sem_top_k(CallableLLM(rules.dearer_order), orders, prompt="is the first order dearer?", k=15, id_col="o_orderkey", input_fields=["o_totalprice"])


@_query("SELECT l_returnflag, count(*) AS n, sum(round(l_quantity))::BIGINT AS total, 0 AS errors FROM lineitem GROUP BY l_returnflag")
def sem_agg_lines(spark, d):
    """Counts and sums of groups that are far larger than a prompt, by answers about lists of rows and of answers."""
    lines = _table(spark, d, "lineitem").select("l_returnflag", "l_quantity")
    made = sem_agg(CallableLLM(rules.count_and_add), lines, prompt="count and add up", group_columns=["l_returnflag"], budget=2000)
    answer = F.from_json("summary", "n bigint, total bigint")
    return made.select("l_returnflag", answer["n"].alias("n"), answer["total"].alias("total"), "errors")


@_query("SELECT family, count(*) AS n, count(DISTINCT user_id) AS n_users FROM (SELECT user_id, CASE WHEN event_type IN ('purchase', 'signup') THEN 'money' WHEN event_type IN ('view', 'click') THEN 'browsing' ELSE 'fault' END AS family FROM events) GROUP BY family")
def sem_group_events(spark, d):
    """Events grouped by labels that a model finds in a sample, merges, and gives to every row."""
    events = _table(spark, d, "events").select("event_type", "user_id")
    labels = discover_labels(CallableLLM(rules.event_family), events, prompt="family of event", sample=500)
    grouped = sem_group_by(CallableLLM(rules.known_family), events, prompt="family of event", output="family", labels=labels)
    return grouped.groupBy("family").agg(F.count("*").alias("n"), F.countDistinct("user_id").alias("n_users"))


def _plan(*steps):
    return [{"type": "dask", "operation": name, "params": params} for name, params in steps]


def _agent(name: str, table: str, columns: list[str], steps, sql: str, out: list[str] | None = None):
    def run(spark, d):
        made = run_plan(_plan(*steps), _table(spark, d, table).select(*columns))
        return made.select(*out) if out else made

    run.__name__ = name
    _query(sql)(run)


LINE = ["l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount"]
_agent("agent_add_column", "lineitem", LINE, [("add_column", {"new_column": "net", "expression": "l_extendedprice * (1 - l_discount)"}), ("drop_columns", {"columns": ["l_extendedprice", "l_discount", "l_quantity"]})], "SELECT l_orderkey, l_linenumber, l_extendedprice * (1 - l_discount) AS net FROM lineitem")
_agent("agent_apply_function", "orders", ["o_orderkey", "o_orderdate"], [("apply_function", {"new_column": "o_year", "source_column": "o_orderdate", "function": "year(x)", "dtype": "int64"}), ("drop_columns", {"columns": ["o_orderdate"]})], "SELECT o_orderkey, year(o_orderdate)::BIGINT AS o_year FROM orders")
_agent("agent_rename_columns", "nation", ["n_nationkey", "n_name"], [("rename_columns", {"rename_map": {"n_name": "nation name", "absent": "x"}})], 'SELECT n_nationkey, n_name AS "nation name" FROM nation')
_agent("agent_astype_column", "part", ["p_partkey", "p_size"], [("astype_column", {"column": "p_size", "dtype": "float64"})], "SELECT p_partkey, p_size::DOUBLE AS p_size FROM part")
_agent("agent_fillna", "events", ["event_id", "event_type"], [("add_column", {"new_column": "kind", "expression": "nullif(event_type, 'error')"}), ("fillna", {"column": "kind", "value": "none"})], "SELECT event_id, event_type, coalesce(nullif(event_type, 'error'), 'none') AS kind FROM events")
_agent("agent_replace_values", "customer", ["c_custkey", "c_mktsegment"], [("replace_values", {"column": "c_mktsegment", "to_replace": ["MACHINERY", "BUILDING"], "value": "HEAVY"})], "SELECT c_custkey, CASE WHEN c_mktsegment IN ('MACHINERY', 'BUILDING') THEN 'HEAVY' ELSE c_mktsegment END AS c_mktsegment FROM customer")
_agent("agent_conditional_column", "lineitem", ["l_orderkey", "l_linenumber", "l_extendedprice"], [("conditional_column", {"new_column": "band", "conditions": ["l_extendedprice < 10000", "l_extendedprice < 50000"], "choices": ["low", "middle"], "default": "high"})], "SELECT l_orderkey, l_linenumber, l_extendedprice, CASE WHEN l_extendedprice < 10000 THEN 'low' WHEN l_extendedprice < 50000 THEN 'middle' ELSE 'high' END AS band FROM lineitem")
_agent("agent_select_rows", "orders", ["o_orderkey", "o_totalprice"], [("select_rows", {"condition": "o_totalprice > 100000 and o_orderkey % 2 = 0"})], "SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > 100000 AND o_orderkey % 2 = 0")
_agent("agent_drop_duplicates", "events", ["user_id", "event_type", "event_id"], [("drop_duplicates", {"columns": ["user_id", "event_type"], "order_by": ["event_id"]})], "SELECT user_id, event_type, min(event_id) AS event_id FROM events GROUP BY user_id, event_type")
_agent("agent_dropna", "events", ["event_id", "event_type"], [("add_column", {"new_column": "kind", "expression": "nullif(event_type, 'error')"}), ("dropna", {"columns": ["kind"]})], "SELECT event_id, event_type, event_type AS kind FROM events WHERE event_type <> 'error'")
_agent("agent_select_columns", "customer", ["c_custkey", "c_name", "c_acctbal"], [("select_columns", {"columns": ["c_name", "c_custkey"]})], "SELECT c_name, c_custkey FROM customer")
_agent("agent_drop_columns", "supplier", ["s_suppkey", "s_name", "s_nationkey", "s_acctbal"], [("drop_columns", {"columns": ["s_acctbal", "s_nationkey"]})], "SELECT s_suppkey, s_name FROM supplier")
_agent("agent_group_by", "orders", ["o_orderstatus", "o_totalprice"], [("group_by", {"group_columns": ["o_orderstatus"]}), ("group_by_agg", {"aggregations": {"o_totalprice": ["count", "min"]}})], "SELECT o_orderstatus, count(o_totalprice) AS o_totalprice_count, min(o_totalprice) AS o_totalprice_min FROM orders GROUP BY o_orderstatus")
_agent("agent_group_by_agg", "lineitem", ["l_returnflag", "l_linestatus", "l_quantity", "l_orderkey"], [("group_by_agg", {"group_columns": ["l_returnflag", "l_linestatus"], "aggregations": {"l_quantity": "sum", "l_orderkey": "nunique"}})], "SELECT l_returnflag, l_linestatus, sum(l_quantity) AS l_quantity, count(DISTINCT l_orderkey) AS l_orderkey FROM lineitem GROUP BY ALL")
_agent("agent_sort_values", "nation", ["n_nationkey", "n_name", "n_regionkey"], [("sort_values", {"columns": ["n_regionkey", "n_name"], "ascending": [True, False]})], "SELECT n_nationkey, n_name, n_regionkey FROM nation ORDER BY n_regionkey, n_name DESC")


@_query("SELECT event_type, sum(n) AS n, upper(event_type) AS note FROM (SELECT event_type, user_id, count(*) AS n FROM events GROUP BY ALL) WHERE event_type IN ('purchase', 'signup') GROUP BY event_type")
def agent_mixed_plan(spark, d):
    plan = _plan(("group_by_agg", {"group_columns": ["event_type"], "aggregations": {"event_id": "count"}}), ("rename_columns", {"rename_map": {"event_id": "n"}}))
    plan += [{"type": "primitive", "operation": "Map", "subprompt": "note", "output_fields": ["note"]}, {"type": "primitive", "operation": "Filter", "params": {"subprompt": "bought or signed up"}}]

    def rule(text):
        row = json.loads(text)
        return {"note": row["event_type"].upper(), "__filter__": row["event_type"] in ("purchase", "signup")}

    return run_plan(plan, _table(spark, d, "events").select("event_type", "event_id"), CallableLLM(rule))


@register_function("vowel_count", "int")
def vowel_count(texts: pa.Array) -> pa.Array:
    """A registered Arrow function: vowels of each text."""
    return pc.count_substring_regex(texts, "[aeiouAEIOU]")


@register_table_function("words_of", "word string, place int")
class WordsOf:
    """A registered table function: the words of a text and their places."""

    def eval(self, text: str):
        for at, word in enumerate((text or "").split(" "), 1):
            yield word, at


_agent("agent_registered_function", "part", ["p_partkey", "p_name", "p_type"], [("rename_columns", {"rename_map": {"p_type": "x"}}), ("apply_function", {"new_column": "vowels", "source_column": "p_name", "function": "vowel_count"}), ("apply_function", {"new_column": "both", "source_column": "p_name", "function": "vowel_count(x) + char_length(x)"})], "SELECT p_partkey, p_name, p_type AS x, length(regexp_replace(p_name, '[^aeiouAEIOU]', '', 'g'))::INT AS vowels, (length(regexp_replace(p_name, '[^aeiouAEIOU]', '', 'g')) + length(p_name))::INT AS both FROM part")
_agent("agent_table_function", "part", ["p_partkey", "p_name"], [("table_function", {"function": "words_of", "arguments": ["p_name"]}), ("group_by_agg", {"group_columns": ["word", "place"], "aggregations": {"p_partkey": "count"}})], "SELECT word, place::INT AS place, count(*) AS p_partkey FROM (SELECT unnest(string_split(p_name, ' ')) AS word, generate_subscripts(string_split(p_name, ' '), 1) AS place FROM part) GROUP BY ALL")
_agent("agent_shift", "events", ["event_id", "user_id", "value"], [("shift", {"column": "value", "new_column": "before", "partition_by": ["user_id"], "order_by": ["event_id"], "periods": 2})], "SELECT event_id, user_id, value, lag(value, 2) OVER (PARTITION BY user_id ORDER BY event_id) AS before FROM events")
_agent("agent_window_agg", "events", ["event_id", "user_id", "value"], [("window_agg", {"column": "value", "new_column": "most", "function": "max", "partition_by": ["user_id"], "order_by": ["event_id"], "within": [-100, 0]}), ("window_agg", {"column": "event_id", "new_column": "n", "function": "count", "partition_by": ["user_id"], "order_by": ["event_id"], "rows": [-3, None]})], "SELECT event_id, user_id, value, max(value) OVER (PARTITION BY user_id ORDER BY event_id RANGE BETWEEN 100 PRECEDING AND CURRENT ROW) AS most, count(event_id) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 3 PRECEDING AND UNBOUNDED FOLLOWING) AS n FROM events")


@_query("SELECT e.event_id, e.user_id, o.o_orderkey AS o_orderkey, c.c_name FROM events e ASOF LEFT JOIN orders o ON e.user_id = o.o_custkey AND e.event_id >= o.o_orderkey LEFT JOIN customer c ON e.user_id = c.c_custkey")
def agent_frames(spark, d):
    """A plan over several frames: the last order of each event's user before it, and the customer."""
    plan = _plan(("asof_join", {"right": "orders", "by": ["user_id"], "on": "event_id", "right_by": ["o_custkey"], "right_on": "o_orderkey"}), ("join", {"right": "customers", "on": ["user_id"], "right_on": ["c_custkey"], "how": "left"}))
    frames = {"orders": _table(spark, d, "orders").select("o_custkey", "o_orderkey"), "customers": _table(spark, d, "customer").select("c_custkey", "c_name")}
    return run_plan(plan, _table(spark, d, "events").select("event_id", "user_id"), frames=frames)


@_query("SELECT * FROM (SELECT 0 AS step, 'input' AS name, count(*) AS n FROM events UNION ALL SELECT 1, 'select_rows', count(*) FILTER (value > 10) FROM events UNION ALL SELECT 2, 'group_by_agg', count(DISTINCT user_id) FILTER (value > 10) FROM events UNION ALL SELECT 3, 'select_rows', count(*) FROM (SELECT user_id FROM events WHERE value > 10 GROUP BY user_id HAVING count(*) > 5))")
def agent_step_counts(spark, d):
    """Rows that each step of a plan gave, observed while its result is written."""
    counts = StepCounts()
    plan = _plan(("select_rows", {"condition": "value > 10"}), ("group_by_agg", {"group_columns": ["user_id"], "aggregations": {"event_id": "count"}}), ("select_rows", {"condition": "event_id > 5"}))
    run_plan(plan, _table(spark, d, "events").select("user_id", "event_id", "value"), counts=counts).write.format("noop").mode("overwrite").save()
    return spark.createDataFrame([(k, name, n) for k, (name, n) in enumerate(counts.rows())], "step int, name string, n long")


@_query("SELECT o_orderkey, o_totalprice / 2 AS half FROM orders WHERE o_totalprice > 200000")
def agent_replan_after_error(spark, d):
    bad = json.dumps(_plan(("add_column", {"new_column": "half", "expression": "no_such_column / 2"})))
    good = json.dumps(_plan(("select_rows", {"condition": "o_totalprice > 200000"}), ("add_column", {"new_column": "half", "expression": "o_totalprice / 2"}), ("select_columns", {"columns": ["o_orderkey", "half"]})))
    return Agent(ScriptedLLM(["no JSON", bad, f"```json\n{good}\n```"])).do("halve large prices", _table(spark, d, "orders").select("o_orderkey", "o_totalprice"))


@_query("SELECT * FROM customer")
def finalize_drop_internal(spark, d):
    df = _table(spark, d, "customer").withColumn("__sem_deleted", F.lit(False)).withColumn("__sem_x_output", F.lit("x"))
    return finalize(finalize(df))
