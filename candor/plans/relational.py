"""Queries over sources, coercions, filters, joins, counts, ranking, sampling, splitting and set operations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from candor.functions import text as T
from candor.functions.lexicon import EN
from candor.operators import assemble as A
from candor.operators import coerce as C
from candor.operators import metrics as M
from candor.plans import base as B
from candor.plans.base import QA, query
from candor.session import table
from candor.sources import io


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders")


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with labels, two scores with ties, weak and manual labels, reasons and splits: inputs of assembly and metrics."""
    d = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
    k = F.col("doc_id")
    return d.select(
        "doc_id",
        "text",
        "lang",
        "source",
        "n_chars",
        "quality",
        "toxic",
        ((F.col("n_chars") % 97) / 96.0).alias("score_a"),
        ((F.col("n_chars") % 41) / 40.0).alias("score_b"),
        F.when(k % 7 != 0, F.col("quality")).alias("weak_label"),
        F.when(k % 11 == 0, "True").when(k % 11 == 1, "0").when(k % 11 == 2, "unsure").alias("is_hallucination_manual"),
        F.when(k % 3 == 0, "exact_match").when(k % 3 == 1, "high_token_f1").alias("weak_label_reason"),
        F.when(k % 4 == 0, "validation").otherwise("train").alias("split_name"),
    )


LABELLED = """lab as (select d.doc_id, d.text, d.lang, d.source, d.n_chars, l.quality, l.toxic, (d.n_chars % 97) / 96.0::double as score_a, (d.n_chars % 41) / 40.0::double as score_b,
  case when d.doc_id % 7 <> 0 then l.quality end as weak_label,
  case d.doc_id % 11 when 0 then 'True' when 1 then '0' when 2 then 'unsure' end as is_hallucination_manual,
  case d.doc_id % 3 when 0 then 'exact_match' when 1 then 'high_token_f1' end as weak_label_reason,
  case when d.doc_id % 4 = 0 then 'validation' else 'train' end as split_name from documents d join labels l using (doc_id))"""
MANUAL = "case when lower(is_hallucination_manual) in ('true', '1') then 1 when lower(is_hallucination_manual) in ('false', '0') then 0 end"


def round_trip(kind: str):  # noqa: ANN201
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        path = f"{io.scratch(spark)}/nation.{kind}"
        df = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment")
        io.write_table(df, path)
        return io.read_table(spark, path, schema="c_custkey long, c_name string, c_mktsegment string")

    return run


for _kind in ("parquet", "csv", "jsonl"):
    query("select c_custkey, c_name, c_mktsegment from customer", name=f"src1_2_3_snk1_{_kind}_round_trip")(round_trip(_kind))


@query("select c_custkey, c_name, null::varchar as s_name from customer union all select null, null, s_name from supplier")
def src9_set1_widening_concat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.union_widening(table(spark, sf_dir, "customer").select("c_custkey", "c_name"), table(spark, sf_dir, "supplier").select("s_name"))


_PLACES = "p as (select * from (values (0, 'train/a_with_answers.parquet', 'train'), (1, 'valid/b_with_answers.parquet', 'validation'), (2, 'misc/c_with_answers.parquet', 'unspecified')) as x(r, generated_file, path_split))"


@query(f"with {_PLACES}, c as (select c_custkey, c_name, c_mktsegment, generated_file, path_split from customer join p on c_custkey % 4 = r) select 'all' as found, *, case path_split when 'train' then 1 when 'validation' then 2 else 0 end as table_order from c union all select 'train', *, 0 from c where path_split = 'train'")
def src4_5_6_7_8_srt3_discovery(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers written below three folders, a fourth table that isn't to be found, and what is found in all and in one split."""
    root, customers = io.scratch(spark), table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment")
    for k, place in enumerate(("train/a_with_answers.parquet", "valid/b_with_answers.parquet", "misc/c_with_answers.parquet", "train/labels.parquet")):
        io.write_table(customers.where(F.col("c_custkey") % 4 == k), f"{root}/{place}")
    found = {"all": io.discover(spark, root, "*_with_answers.parquet"), "train": io.discover(spark, root, "*_with_answers.parquet", split="train", schema=customers.schema)}
    out = A.union_widening(*(A.tagged(d, "found", k) for k, d in found.items()))
    return out.withColumn("generated_file", F.array_join(F.slice(F.split("generated_file", "/"), -2, 2), "/"))


@query("select o_orderkey as uid, o_orderstatus as question, o_orderpriority as gold_answer, 'orders' as source_dataset, 'train' as source_split from orders where length(o_orderpriority) <= 40 and len(list_filter(string_split_regex(o_orderpriority, '\\s+'), lambda w: w <> '')) <= 5 and o_orderstatus <> '' and o_orderpriority <> ''")
def src10_11_fil8_9_question_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = io.renamed_source(_orders(spark, sf_dir), {"o_orderkey": "uid", "o_orderstatus": "question", "o_orderpriority": "gold_answer"}, "orders", "train")
    return d.where(A.short_answer(F.col("gold_answer")) & (F.col("question") != "") & (F.col("gold_answer") != ""))


@query("select o_orderkey, o_totalprice from orders where o_orderkey not in (select l_orderkey from lineitem where l_quantity > 45)")
def src12_join4_pending(spark: SparkSession, sf_dir: str) -> DataFrame:
    cached = table(spark, sf_dir, "lineitem").where("l_quantity > 45").select(F.col("l_orderkey").alias("o_orderkey"))
    return io.pending(_orders(spark, sf_dir).select("o_orderkey", "o_totalprice"), cached, "o_orderkey")


@query("select c_custkey, c_name from customer where c_custkey not in (select o_custkey from orders where o_totalprice > 100000)")
def src14_join2_exclusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    other = _orders(spark, sf_dir).where("o_totalprice > 100000").select(F.col("o_custkey").alias("c_custkey"))
    return A.excluding(table(spark, sf_dir, "customer").select("c_custkey", "c_name"), other, ["c_custkey"])


@query("select l_orderkey, l_linenumber, l_quantity from lineitem l where not exists (select 1 from lineitem k where k.l_orderkey = l.l_orderkey and k.l_linenumber = l.l_linenumber and k.l_discount > 0.05)")
def join3_inc3_composite_resume(spark: SparkSession, sf_dir: str) -> DataFrame:
    from candor.streaming.incremental import not_done

    d = table(spark, sf_dir, "lineitem")
    return not_done(d.select("l_orderkey", "l_linenumber", "l_quantity"), d.where("l_discount > 0.05"), ["l_orderkey", "l_linenumber"])


@query("select o_orderkey, c_name, o_totalprice from orders join customer on o_custkey = c_custkey where o_totalprice > 150000")
def join1_feature_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    feats = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_name")
    return _orders(spark, sf_dir).where("o_totalprice > 150000").join(feats, "o_custkey").select("o_orderkey", "c_name", "o_totalprice")


@query("with a as (select n_name, row_number() over (order by n_name) as k from nation), b as (select n_nationkey, row_number() over (order by n_nationkey desc) as k from nation) select n_name, n_nationkey from a join b using (k)")
def join6_positional(spark: SparkSession, sf_dir: str) -> DataFrame:
    from candor.operators.rank import positional_join

    d = table(spark, sf_dir, "nation")
    return positional_join(d.select("n_name"), d.select("n_nationkey", (-F.col("n_nationkey")).alias("_desc")), ["n_name"], ["_desc"]).select("n_name", "n_nationkey")


@query(f"with {QA} select id, len(list_filter({B.toks('model_answer')}, lambda w: contains({B.norm('context')}, w))) as n_in_context from qa")
def join8_token_membership(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = F.struct(T.tokens(F.col("model_answer")).alias("t"), T.normalize(F.col("context")).alias("c"))
    return B.qa(spark, sf_dir).select("id", F.size(T.bind(both, lambda z: F.filter(z["t"], lambda x: F.contains(z["c"], x)))).cast("long").alias("n_in_context"))


@query("select event_id, coalesce(props, '') as props_text, coalesce(try_cast(value as double), 0) as value_or_zero, cast(event_id as varchar) as id_text, case when isnan(coalesce(value, 0)) then 0 when coalesce(value, 0) > 0 then 1 else 0 end as is_positive from events")
def prj1_3_14_15_16_17_coercions(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "events")
    return d.select("event_id", T.text(F.col("props")).alias("props_text"), C.number_or_zero(F.col("value")).alias("value_or_zero"), F.col("event_id").cast("string").alias("id_text"), C.to_binary(d, "value").alias("is_positive"))


@query(f"with {LABELLED} select doc_id, {MANUAL} as manual, case when weak_label is null then null else weak_label end as weak from lab")
def prj13_boolish(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = labelled(spark, sf_dir)
    return d.select("doc_id", C.boolish(d, "is_hallucination_manual").alias("manual"), C.boolish(d, "weak_label").alias("weak"))


@query("select p_partkey, array_to_string(list_filter(list_transform(string_split(p_name, ' '), lambda w: trim(w)), lambda w: w <> ''), '|') as items from part")
def prj4_5_6_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "part").select("p_partkey", F.to_json(F.split("p_name", " ")).alias("j"))
    return d.select("p_partkey", F.array_join(C.as_list(d, "j"), "|").alias("items"))


@query(f"with {QA} select id, question, array_to_string(gold_answers_text, '|') as golds from qa")
def prj2_7_question_and_golds(spark: SparkSession, sf_dir: str) -> DataFrame:
    from candor.functions.features import question_text

    d = B.qa(spark, sf_dir)
    return d.select("id", question_text(d).alias("question"), F.array_join(F.col(C.gold_column(d)), "|").alias("golds"))


@query(r"select doc_id, trim(regexp_replace(text, '\s+', ' ', 'g')) as plain from documents")
def prj18_whitespace(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", T.normalize_whitespace(F.col("text")).alias("plain"))


@query("select c_custkey, c_mktsegment from customer where c_mktsegment in ('BUILDING', 'MACHINERY')")
def prj29_comma_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A parameter that lists values, with blanks and an empty item."""
    wanted = C.comma_set(" BUILDING,, MACHINERY ")
    return table(spark, sf_dir, "customer").where(F.col("c_mktsegment").isin(wanted)).select("c_custkey", "c_mktsegment")


@query(f"with {QA} select id, conv_id, turn, len({B.toks('model_answer')}) as n_answer, len({B.toks('question')}) as n_question from qa")
def join7_columns_by_row(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Derived columns put beside those of their row: a projection, as rows never part."""
    derived = {"n_answer": F.size(T.tokens(F.col("model_answer"))).cast("long"), "n_question": F.size(T.tokens(F.col("question"))).cast("long")}
    return B.qa(spark, sf_dir).withColumns(derived).select("id", "conv_id", "turn", *derived)


@query("select s_suppkey as id, s_name as question, null::varchar as context, 1 as label from supplier")
def prj19_23_schema_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql.types import StructType

    d = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("question"), F.lit(0).alias("dropped"))
    return C.align(d, StructType.fromDDL("id long, question string, context string, label int"), {"label": 1})


@query("select -row_number() over (order by s_suppkey) as id, s_suppkey as source_id, s_suppkey as source_id_original from supplier")
def prj20_synthetic_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("source_id"))
    return A.synthetic_ids(d, True, ["source_id"]).select("id", "source_id", "source_id_original")


@query("select o_orderkey, row_number() over (order by o_orderkey) - 1 as _row_id, 'factual_' || row_number() over (order by o_orderkey) || '_orders_' || o_orderkey as id from orders")
def prj21_22_row_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = A.row_ids(_orders(spark, sf_dir).select("o_orderkey"), ["o_orderkey"])
    return d.select("o_orderkey", "_row_id", F.concat_ws("_", F.lit("factual"), (F.col("_row_id") + 1).cast("string"), F.lit("orders"), F.col("o_orderkey").cast("string")).alias("id"))


@query("select l_orderkey, l_linenumber, cast(l_discount as double) as l_discount, 0.0::double as absent, cast(l_quantity as double) as l_quantity from lineitem")
def prj24_25_model_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, _unknown = C.drop_features(table(spark, sf_dir, "lineitem"), ["l_tax", "no_such"])
    return C.model_matrix(d, ["l_discount", "absent", "l_quantity"], keep=["l_orderkey", "l_linenumber"])


@query("select r_name, r_regionkey from region")
def snk3_reorder(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.reorder(table(spark, sf_dir, "region").select("r_regionkey", "r_name"), ["r_name"])


@query(f"with {LABELLED} select doc_id, 'base' as kind from lab where weak_label = 0 and coalesce({MANUAL}, 0) <> 1 union all select doc_id, 'positive' from lab where {MANUAL} = 1 union all select doc_id, 'negative' from lab where {MANUAL} = 0 union all select doc_id, 'review' from lab where weak_label is null union all select doc_id, 'labelled' from lab where weak_label in (0, 1) union all select doc_id, 'trainable' from lab where weak_label is not null or is_hallucination_manual is not null")
def fil2_3_4_15_16_17_label_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = labelled(spark, sf_dir)
    parts = {"base": A.base_negatives(d), "positive": A.manual_rows(d, True), "negative": A.manual_rows(d, False), "review": d.where("weak_label is null"), "labelled": d.where("weak_label in (0, 1)"), "trainable": d.where("weak_label is not null or is_hallucination_manual is not null")}
    return A.union_widening(*(A.tagged(p.select("doc_id"), "kind", k) for k, p in parts.items()))


@query(f"with {LABELLED} select doc_id from lab where split_name = 'train' and weak_label = 0 and (is_hallucination_manual is null or {MANUAL} = 0) order by doc_id limit 50")
def fil1_5_srt2_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.generation_candidates(labelled(spark, sf_dir), "train", ["doc_id"], 50).select("doc_id")


@query(f"with {LABELLED}, e as (select *, coalesce({MANUAL}, case when weak_label in (0, 1) then weak_label end) as effective_label from lab) select doc_id, effective_label, weak_label_reason from e where effective_label = 0 and coalesce(weak_label_reason, '') in ('exact_match')")
def fil6_7_srt4_lab5_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    from candor.operators.labels import effective_label

    d = labelled(spark, sf_dir).withColumn("effective_label", effective_label(F.col("weak_label"), F.col("is_hallucination_manual")))
    return A.negatives_by_reason(d, ["exact_match"]).select("doc_id", "effective_label", "weak_label_reason")


_UNITS = "|".join(EN.units)
_HARD = "|".join(EN.hard_questions)


@query(rf"with {QA}, g as (select *, array_to_string(list_filter(gold_answers_text, lambda x: trim(x) <> ''), ' | ') as j from qa) select id, regexp_matches(j, '(?i)\d{{4}}|\d+[.,]\d+|\d+ (?:{_UNITS})') or regexp_matches(question, '(?i)(?:{_HARD})') or regexp_matches(coalesce(context, ''), '\d{{4,}}') or regexp_matches(j, '[А-ЯЁ][а-яё]+ [А-ЯЁ][а-яё]+') as hard from g")
def fil10_11_12_13_14_hard_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = B.qa(spark, sf_dir)
    return d.select("id", A.hard_row(d, EN).alias("hard"))


@query("select o_orderstatus, o_orderpriority, count(*) as n from orders group by all")
def agg1_3_value_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.value_counts(_orders(spark, sf_dir), "o_orderstatus", "o_orderpriority")


@query("select l_partkey, count(*) as n from lineitem group by all order by n desc, l_partkey limit 12")
def agg2_top_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.value_counts(table(spark, sf_dir, "lineitem"), "l_partkey", top=12)


@query(f"with {LABELLED} select count(*) as rows, count(*) filter (weak_label = 1) as positives, count(*) filter (weak_label = 0) as negatives, count(weak_label) as labelled from lab")
def agg4_label_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.label_counts(labelled(spark, sf_dir), "weak_label")


@query(f"""with {LABELLED}, t as (select score_a as s, sum(quality) as pos, count(*) as n from lab group by 1),
c as (select *, sum(pos) over (order by s desc) as cp, sum(n) over (order by s desc) as cn from t)
select round(sum(pos * cp::double / cn) / sum(pos), 9) as pr_auc,
round(sum(pos * ((select sum(n - pos) from t) - (cn - cp) + (n - pos) / 2.0)) / (sum(pos) * sum(n - pos)), 9) as roc_auc from c""")
def agg5_6_ranking_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.ranking_metrics(labelled(spark, sf_dir), F.col("quality"), F.col("score_a")).select(F.round("pr_auc", 9).alias("pr_auc"), F.round("roc_auc", 9).alias("roc_auc"))


@query(f"""with {LABELLED}, s as (select count(*) as n, count(*) filter (quality = 1 and score_a >= 0.5) as tp, count(*) filter (score_a >= 0.5) as p, sum(quality) as q, count(*) filter ((score_a >= 0.5) = (quality = 1)) as r from lab)
select n as rows, 0.5::double as threshold, round(r::double / n, 9) as accuracy_at_threshold, round(tp::double / p, 9) as precision_at_threshold, round(tp::double / q, 9) as recall_at_threshold, round(2.0 * tp::double / (p + q), 9) as f1_at_threshold from s""")
def agg7_threshold_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = M.threshold_metrics(labelled(spark, sf_dir), F.col("quality"), F.col("score_a"))
    return d.select("rows", "threshold", *(F.round(c, 9).alias(c) for c in d.columns[2:]))


@query(f"with {LABELLED} select round_even(count(*) filter (quality = 0) * 4.0, 0)::bigint as wanted, greatest(0, round_even(count(*) filter (quality = 0) * 4.0, 0)::bigint - count(*) filter (quality = 1)) as missing from lab")
def agg12_target_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = labelled(spark, sf_dir).agg(F.count_if(F.col("quality") == 0).alias("p"), F.count_if(F.col("quality") == 1).alias("q"))
    return d.select(F.bround(F.col("p") * F.lit(4.0), 0).cast("long").alias("wanted"), F.greatest(F.lit(0).cast("long"), F.bround(F.col("p") * F.lit(4.0), 0).cast("long") - F.col("q")).alias("missing"))


@query("select o_orderkey, o_custkey, o_totalprice from orders qualify row_number() over (partition by o_custkey order by o_totalprice desc, o_orderkey) <= 3")
def win2_head_per_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.head_per_group(_orders(spark, sf_dir).select("o_orderkey", "o_custkey", "o_totalprice"), ["o_custkey"], [F.desc("o_totalprice"), "o_orderkey"], 3)


@query("select l_orderkey, l_linenumber, l_partkey from lineitem qualify row_number() over (partition by l_partkey order by l_orderkey, l_linenumber) = 1")
def win3_5_first_per_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.first_per_key(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey"), ["l_partkey"], ["l_orderkey", "l_linenumber"])


@query("select doc_id, source from documents qualify row_number() over (partition by source, lower(trim(text)) order by doc_id) = 1")
def win4_dedup_by_normalised(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", "source", F.md5(F.lower(F.trim("text"))).alias("k"))
    return A.first_per_key(d, ["source", "k"], ["doc_id"]).select("doc_id", "source")


@query("select o_orderkey, o_totalprice from orders order by md5(o_orderkey || '|42'), o_orderkey limit 100")
def win6_7_exact_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.shuffled(A.exact_sample(_orders(spark, sf_dir).select("o_orderkey", "o_totalprice"), 100, "o_orderkey"), "o_orderkey")


@query("select c_custkey, case when row_number() over (order by md5(c_custkey || '|42'), c_custkey) <= greatest(1, round_even((select count(*) from customer) * 0.2, 0)) then 'validation' else 'train' end as split_name from customer")
def win8_random_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.random_split(table(spark, sf_dir, "customer").select("c_custkey"), "c_custkey")


_APPORTION = """cnt as (select g, count(*) as c from rows group by g), tot as (select sum(c) as n from cnt),
raw as (select g, c, {total} * c::double / n as r from cnt, tot), fl as (select g, c, r, least(floor(r), c)::bigint as f from raw),
rk as (select *, row_number() over (order by r - f desc, g desc) as k from fl), want as (select g, f + case when k <= {total} - (select sum(f) from fl) then 1 else 0 end as w from rk)"""


@query("with rows as (select c_custkey, c_mktsegment as g from customer), " + _APPORTION.format(total="(select ceil(count(*) * 0.2) from rows)") + " select c_custkey, g as c_mktsegment, case when row_number() over (partition by g order by md5(c_custkey || '|42'), c_custkey) <= w then 'validation' else 'train' end as split_name from rows join want using (g)")
def win9_stratified_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.stratified_split(table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment"), "c_mktsegment", "c_custkey")


@query("with rows as (select o_orderkey, o_orderpriority as g from orders), " + _APPORTION.format(total="97") + " select o_orderkey, g as o_orderpriority from rows join want using (g) qualify row_number() over (partition by g order by md5(o_orderkey || '|42'), o_orderkey) <= w")
def win10_proportional_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.proportional_sample(_orders(spark, sf_dir).select("o_orderkey", "o_orderpriority"), "o_orderpriority", "o_orderkey", 97)


@query(f"with {LABELLED} select doc_id, 'hard' as poc_source from lab where quality = 0 union all select doc_id, 'easy' from lab where quality = 1")
def set2_tagged_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = labelled(spark, sf_dir).select("doc_id", "quality")
    return A.union_widening(A.tagged(d.where("quality = 0"), "poc_source", "hard"), A.tagged(d.where("quality = 1"), "poc_source", "easy")).drop("quality")


_METRICS = f"""with {LABELLED}, t as (select score_a as s, sum(quality) as pos, count(*) as n from lab group by 1),
c as (select *, sum(pos) over (order by s desc) as cp, sum(n) over (order by s desc) as cn from t),
r as (select sum(pos * cp::double / cn) / sum(pos) as pr_auc, sum(pos * ((select sum(n - pos) from t) - (cn - cp) + (n - pos) / 2.0)) / (sum(pos) * sum(n - pos)) as roc_auc from c),
s as (select count(*) as n, count(*) filter (quality = 1 and score_a >= 0.5) as tp, count(*) filter (score_a >= 0.5) as p, sum(quality) as q, count(*) filter ((score_a >= 0.5) = (quality = 1)) as h from lab)
select n as rows, 0.5::double as threshold, round(h::double / n, 9) as accuracy_at_threshold, round(tp::double / p, 9) as precision_at_threshold, round(tp::double / q, 9) as recall_at_threshold, round(2.0 * tp::double / (p + q), 9) as f1_at_threshold, round(pr_auc, 9) as pr_auc, round(roc_auc, 9) as roc_auc from s, r"""


@query(_METRICS)
def snk5_8_metrics_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{io.scratch(spark)}/metrics.json"
    io.write_json(spark, io.row_as_dict(M.evaluate(labelled(spark, sf_dir), F.col("quality"), F.col("score_a"))), path)
    kind = "rows long, threshold double, accuracy_at_threshold double, precision_at_threshold double, recall_at_threshold double, f1_at_threshold double, pr_auc double, roc_auc double"
    d = spark.read.schema(kind).json(path, multiLine=True)
    return d.select("rows", "threshold", *(F.round(c, 9).alias(c) for c in d.columns[2:]))
