"""Search, relevance, contexts and whole batches."""

from pyspark.sql import functions as F

from fundweave import fixed_values as fv
from fundweave.functions import vectors as vec
from fundweave.operators import context as cx, relevance as rv, search
from fundweave.plans import answer_batch as ab, plain_retrieval as pr
from fundweave.session import scratch_path
from fundweave.sources import vector_table as vt
from fundweave.workload import chunking, views
from fundweave.workload.catalog import VIEWS, query

_DIM = 64

VIEWS["scored_v"] = """
  select q.question_id, v.namespace, v.chunk_id, v.fund, v.file, v.has_pl,
    round(list_dot_product(q.embedding, v.embedding)
          / (sqrt(list_dot_product(q.embedding, q.embedding)) * sqrt(list_dot_product(v.embedding, v.embedding))), 6) as score
  from vector_questions_v q join vectors_v v
    on (q.namespace is null or q.namespace = v.namespace) and (not q.need_pl or v.has_pl)"""
VIEWS["matches_v"] = """
  select * from (select *, row_number() over (partition by question_id order by score desc, namespace, chunk_id) as rank
    from scored_v) where rank <= 10"""
VIEWS["enough_v"] = """
  select * exclude (n) from (select *, count(*) over (partition by question_id) as n
    from matches_v where score >= 0.3) where n >= 3"""
# Walks each question's matches of one fund from best to worst, remembering the last one kept.
VIEWS["gap_steps_v"] = """
  select *, row_number() over (partition by question_id, fund order by rank) as rn from enough_v"""
VIEWS["gap_walk_v"] = """
  select question_id, fund, rn, score as last_kept, true as kept from gap_steps_v where rn = 1
  union all
  select s.question_id, s.fund, s.rn,
    case when abs(s.score - w.last_kept) >= 0.05 then s.score else w.last_kept end, abs(s.score - w.last_kept) >= 0.05
  from gap_walk_v w join gap_steps_v s on s.question_id = w.question_id and s.fund = w.fund and s.rn = w.rn + 1"""
VIEWS["deduplicated_v"] = """
  select s.* exclude (rn) from gap_steps_v s join gap_walk_v w using (question_id, fund, rn) where w.kept"""


def matches(spark, sf_dir):
    vectors = views.vectors(spark, sf_dir)
    return search.with_metadata(
        search.top_k(vectors, views.vector_questions(spark, sf_dir), dim=_DIM), vectors)


_MATCH_COLUMNS = ["question_id", "rank", "namespace", "chunk_id", "score"]
_MATCHES = "select question_id, cast(rank as integer) as rank, namespace, chunk_id, score from"


@query("r1_cosine", """
select a.vec_id, round(list_dot_product(a.embedding::double[], b.embedding::double[])
   / (sqrt(list_dot_product(a.embedding::double[], a.embedding::double[]))
      * sqrt(list_dot_product(b.embedding::double[], b.embedding::double[]))), 6) as score
from embeddings a join embeddings b on b.vec_id = a.vec_id + 1""")
def cosine(spark, sf_dir):
    a = views.table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    b = a.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    return a.join(b, "vec_id").select("vec_id", F.round(vec.cosine(F.col("embedding"), F.col("other")), 6).alias("score"))


@query("r2_top_k_one_namespace", """
select question_id, cast(rank as integer) as rank, chunk_id, score from (
  select q.vec_id as question_id, v.chunk_id, round(list_cosine_similarity(q.embedding::double[], v.embedding), 6) as score,
    row_number() over (partition by q.vec_id order by round(list_cosine_similarity(q.embedding::double[], v.embedding), 6) desc, v.chunk_id) as rank
  from embeddings q cross join vectors_v v where v.namespace = 'holdings') where rank <= 10""")
def top_k_one_namespace(spark, sf_dir):
    vectors = search.having(views.vectors(spark, sf_dir), namespace=fv.HOLDINGS)
    asked = views.vector_questions(spark, sf_dir).withColumns({
        "namespace": F.lit(fv.HOLDINGS), "need_pl": F.lit(False)})
    return search.top_k(vectors, asked, dim=_DIM).select("question_id", "rank", "chunk_id", "score")


@query("r3_top_k_both_namespaces", """
select question_id, cast(rank as integer) as rank, namespace, chunk_id, score from (
  select q.vec_id as question_id, v.namespace, v.chunk_id, round(list_cosine_similarity(q.embedding::double[], v.embedding), 6) as score,
    row_number() over (partition by q.vec_id order by round(list_cosine_similarity(q.embedding::double[], v.embedding), 6) desc, v.namespace, v.chunk_id) as rank
  from embeddings q cross join vectors_v v) where rank <= 10""")
def top_k_both_namespaces(spark, sf_dir):
    asked = views.vector_questions(spark, sf_dir).withColumns({
        "namespace": F.lit(None).cast("string"), "need_pl": F.lit(False)})
    return search.top_k(views.vectors(spark, sf_dir), asked, dim=_DIM).select(*_MATCH_COLUMNS)


@query("r4_routed_top_k", f"{_MATCHES} matches_v")
@query("j2_similarity_join", f"{_MATCHES} matches_v")
def routed_top_k(spark, sf_dir):
    return search.top_k(
        views.vectors(spark, sf_dir), views.vector_questions(spark, sf_dir), dim=_DIM).select(*_MATCH_COLUMNS)


@query("p9_score_floor", f"{_MATCHES} matches_v where score >= 0.3")
def score_floor(spark, sf_dir):
    return rv.relevant(matches(spark, sf_dir)).select(*_MATCH_COLUMNS)


@query("p10_metadata_filter", "select chunk_id, fund, has_pl from vectors_v where has_pl and fund = '3'")
def metadata_filter(spark, sf_dir):
    return search.having(views.vectors(spark, sf_dir), has_pl=True, fund="3").select("chunk_id", "fund", "has_pl")


@query("p10_filters_per_question", """
select question_id, cast(rank as integer) as rank, namespace, chunk_id, score from (
  select s.*, row_number() over (partition by question_id order by score desc, namespace, chunk_id) as rank from scored_v s
  where (question_id % 4 <> 1 or fund = cast(question_id % 10 as varchar)) and (question_id % 4 <> 2 or file = 'trades')
    and (question_id % 4 <> 3 or (fund = cast(question_id % 7 as varchar) and has_pl))) where rank <= 10""")
def filters_per_question(spark, sf_dir):
    """Every question has equality filters of its own."""
    def fund(n):
        return F.create_map(F.lit("fund"), (F.col("question_id") % n).cast("string"))
    kind = F.col("question_id") % 4
    filters = F.when(kind == 1, fund(10)).when(kind == 2, F.create_map(F.lit("file"), F.lit("trades"))).when(
        kind == 3, F.map_concat(fund(7), F.create_map(F.lit("has_pl"), F.lit("true"))))
    asked = views.vector_questions(spark, sf_dir).withColumn("filters", filters)
    return search.top_k(views.vectors(spark, sf_dir), asked, dim=_DIM, filter_fields=("fund", "file")).select(*_MATCH_COLUMNS)


@query("p11_namespace_filter", "select chunk_id, file from vectors_v where namespace = 'trades'")
def namespace_filter(spark, sf_dir):
    """Reads one partition folder of a stored table."""
    path = scratch_path(spark, "vectors")
    vt.write_snapshot(views.vectors(spark, sf_dir), path)
    stored = spark.read.schema(views.vectors(spark, sf_dir).schema).parquet(path)
    return stored.filter(F.col("namespace") == fv.TRADES).select("chunk_id", "file")


@query("p12_match_columns", "select question_id, chunk_id, score, fund, file from matches_v")
def match_columns(spark, sf_dir):
    return matches(spark, sf_dir).select("question_id", "chunk_id", "score", "fund", "file")


@query("r5_validated", """
select question_id, coalesce(kept, 0) as kept,
  case when kept is null then 'Sorry, I cannot find the answer in the provided data' end as error
from (select vec_id as question_id from embeddings)
  left join (select question_id, count(*) as kept from enough_v group by 1) using (question_id)""")
def validated(spark, sf_dir):
    found = search.top_k(views.vectors(spark, sf_dir), views.vector_questions(spark, sf_dir), dim=_DIM)
    return rv.validation_status(views.vector_questions(spark, sf_dir), rv.enough(found))


def deduplicated(spark, sf_dir):
    return rv.drop_near_repeats(rv.enough(matches(spark, sf_dir)))


@query("r6_near_repeats_dropped", f"{_MATCHES} deduplicated_v")
def near_repeats_dropped(spark, sf_dir):
    return deduplicated(spark, sf_dir).select(*_MATCH_COLUMNS)


@query("r8_retrieval_stats", """
select question_id, count(*) as total_chunks, cast(count(distinct fund) as integer) as unique_funds,
  string_agg(distinct fund, ',' order by fund) as funds, string_agg(distinct file, ',' order by file) as sources,
  round(avg(score), 9) as avg_score, max(score) as max_score, min(score) as min_score
from matches_v group by question_id""")
def retrieval_stats(spark, sf_dir):
    return rv.retrieval_stats(matches(spark, sf_dir)).withColumn("avg_score", F.round("avg_score", 9))


@query("a18_strong_share", "select round(avg(case when score > 0.8 then 1.0::double else 0 end), 9) as strong_share from matches_v")
def strong_share(spark, sf_dir):
    return rv.strong_share(matches(spark, sf_dir)).select(F.round("strong_share", 9).alias("strong_share"))


@query("o2_match_union", """
select question_id, namespace, count(*) as matches, max(score) as best from matches_v group by 1, 2""")
def match_union(spark, sf_dir):
    vectors, asked = views.vectors(spark, sf_dir), views.vector_questions(spark, sf_dir)
    lists = [
        search.top_k(vectors.filter(F.col("namespace") == ns), asked, dim=_DIM).drop("rank")
        for ns in (fv.HOLDINGS, fv.TRADES)
    ]
    best = search.best_per_question(lists[0].unionByName(lists[1]), fv.TOP_K)
    return best.groupBy("question_id", "namespace").agg(
        F.count("*").alias("matches"), F.max("score").alias("best"))


@query("c9_chunk_contexts", """
select question_id, string_agg('=== Chunk ' || no || ' (Fund: ' || fund || ', Source: ' || file || ', Relevance: '
    || format('{:.2f}', score) || ') ===' || chr(10) || body || chr(10), chr(10) order by no) as context
from (select d.*, 'vector ' || chunk_id as body, row_number() over (partition by question_id order by rank) as no
  from deduplicated_v d) group by question_id""")
def chunk_contexts(spark, sf_dir):
    found = deduplicated(spark, sf_dir)
    return cx.chunk_contexts(found.withColumn("text", F.concat(F.lit("vector "), F.col("chunk_id").cast("string"))))


@query("c9_empty_contexts", f"""
, found as (select question_id, string_agg('=== Chunk ' || no || ' (Fund: ' || fund || ', Source: ' || file || ', Relevance: '
    || format('{{:.2f}}', score) || ') ===' || chr(10) || body || chr(10), chr(10) order by no) as context
  from (select d.*, 'vector ' || chunk_id as body, row_number() over (partition by question_id order by rank) as no
    from deduplicated_v d) group by question_id)
select question_id, coalesce(context, '{fv.NO_CHUNKS}') as context from vector_questions_v left join found using (question_id)""")
def empty_contexts(spark, sf_dir):
    """A context for every question, also for those that nothing was found for."""
    found = deduplicated(spark, sf_dir).withColumn("text", F.concat(F.lit("vector "), F.col("chunk_id").cast("string")))
    return cx.contexts_for(views.vector_questions(spark, sf_dir), found)


# --- approximate: the cells are sums over digits, so SQL finds the same ones ---

_BITS, _PROBES = 6, 12

VIEWS["planes_v"] = f"""
  select d, b, sum(cast('0x' || substr(md5(d || ':' || b), g * 4 + 1, 4) as bigint)) - 131070 as normal
  from range({_DIM}) r(d), range({_BITS}) s(b), range(4) t(g) group by d, b"""
VIEWS["sides_v"] = """
  select vec_id, b, sum(x * normal) as side
  from (select vec_id, unnest(embedding)::double as x, generate_subscripts(embedding, 1) - 1 as d from embeddings)
    join planes_v using (d) group by vec_id, b"""
VIEWS["cells_v"] = "select vec_id, cast(sum(case when side > 0 then 1 << b else 0 end) as bigint) as cell from sides_v group by vec_id"
VIEWS["probes_v"] = f"""
  select vec_id, xor(cell, flip) as cell from (
    select vec_id, flip, row_number() over (partition by vec_id order by far, flip) as place from (
      select vec_id, flip, sum(case when flip & (1 << b) > 0 then abs(side) else 0 end) as far
      from sides_v, range({1 << _BITS}) f(flip) group by vec_id, flip)) join cells_v using (vec_id)
  where place <= {_PROBES}"""
VIEWS["near_matches_v"] = """
  select * from (select s.*, row_number() over (partition by question_id order by score desc, namespace, chunk_id) as rank
    from scored_v s join probes_v p on p.vec_id = question_id join cells_v c on c.vec_id = chunk_id and c.cell = p.cell)
  where rank <= 10"""


def near_matches(spark, sf_dir):
    """Top-k out of a table stored by namespace and cell."""
    path = scratch_path(spark, "cells")
    vectors = views.vectors(spark, sf_dir)
    vt.write_cells(vectors, path, _DIM, _BITS)
    return search.approximate_top_k(
        vt.open_cells(spark, path, vectors.schema), views.vector_questions(spark, sf_dir), dim=_DIM, bits=_BITS, probes=_PROBES)


@query("r13_approximate_top_k", f"{_MATCHES} near_matches_v")
def approximate_top_k(spark, sf_dir):
    return near_matches(spark, sf_dir).select(*_MATCH_COLUMNS)


@query("r13_recall", """
select count(*) as matches, count(n.chunk_id) as found, round(count(n.chunk_id) / count(*)::double, 9) as recall
from matches_v m left join near_matches_v n using (question_id, chunk_id)""")
def recall(spark, sf_dir):
    """How many of the exact matches the approximate search finds."""
    exact = search.top_k(views.vectors(spark, sf_dir), views.vector_questions(spark, sf_dir), dim=_DIM)
    near = near_matches(spark, sf_dir).select("question_id", "chunk_id", F.lit(True).alias("_found"))
    both = exact.join(near, ["question_id", "chunk_id"], "left")
    return both.agg(F.count("*").alias("matches"), F.count("_found").alias("found")).withColumn(
        "recall", F.round(F.col("found") / F.col("matches"), 9))


# --- hashed text vectors: benchmark passages asked of whole documents ---

def _text_vectors(spark, sf_dir):
    embed = vec.hashed_counts()
    docs = views.document_table(spark, sf_dir).select(
        F.lit("documents").alias("namespace"), F.col("doc_id").alias("chunk_id"),
        embed("text").alias("embedding"), F.lit(None).cast("boolean").alias("has_pl"))
    asked = views.table(spark, sf_dir, "benchmark").select(
        F.col("item_id").alias("question_id"), embed("text").alias("embedding"),
        F.lit(None).cast("string").alias("namespace"), F.lit(False).alias("need_pl"))
    return docs, asked


def _bucket_views(name: str, rows: str, key: str, text: str) -> None:
    words = rf"select {key}, unnest(regexp_split_to_array(lower({text}), '[\x00-/:-@\[-`{{-\x7F]+')) as word from {rows}"
    VIEWS[f"{name}_counts_v"] = f"""
  select {key}, cast('0x' || substr(md5(word), 1, 7) as bigint) % {fv.VECTOR_DIM} as bucket, cast(count(*) as double) as n
  from ({words}) where word <> '' group by 1, 2"""
    VIEWS[f"{name}_norms_v"] = f"select {key}, sqrt(sum(n * n)) as norm from {name}_counts_v group by 1"


_bucket_views("item", "benchmark", "item_id", "text")
_bucket_views("document", "documents", "doc_id", "text")


@query("j3_shared_buckets", """
, scored as (select item_id, doc_id, round(sum(i.n * d.n) / (any_value(p.norm) * any_value(r.norm)), 6) as score
  from item_counts_v i join document_counts_v d using (bucket)
    join item_norms_v p using (item_id) join document_norms_v r using (doc_id) group by item_id, doc_id)
select item_id as question_id, doc_id as chunk_id, score, cast(rank as integer) as rank from (
  select *, row_number() over (partition by item_id order by score desc, doc_id) as rank from scored) where rank <= 10""")
def shared_buckets(spark, sf_dir):
    docs, asked = _text_vectors(spark, sf_dir)
    return search.top_k(docs, asked, positive_only=True).select("question_id", "chunk_id", "score", "rank")


# --- whole batches over chunks of every fund ---

VIEWS["specific_v"] = """
  select distinct question, namespace, need_pl from routed_v where query_type = 'specific'"""
VIEWS["all_asked_v"] = "select distinct question, namespace, need_pl from routed_v"
_bucket_views("chunk", "fund_chunks_v", "chunk_id", "text")


def _search_views(name: str, asked: str) -> None:
    _bucket_views(f"{name}_q", asked, "question", "question")
    VIEWS[f"{name}_scored_v"] = f"""
  select question, chunk_id, round(sum(q.n * c.n) / (any_value(a.norm) * any_value(b.norm)), 6) as score
  from {name}_q_counts_v q join chunk_counts_v c using (bucket)
    join {name}_q_norms_v a using (question) join chunk_norms_v b using (chunk_id) group by question, chunk_id"""
    VIEWS[f"{name}_ranked_v"] = f"""
  select * from (
    select s.question, s.chunk_id, s.score, c.namespace, c.fund, c.text,
      row_number() over (partition by s.question order by s.score desc, c.namespace, s.chunk_id) as rank
    from {name}_scored_v s join {asked} a using (question) join fund_chunks_v c using (chunk_id)
    where (a.namespace is null or a.namespace = c.namespace) and (not a.need_pl or c.has_pl)) where rank <= 10"""
    VIEWS[f"{name}_steps2_v"] = f"""
  select *, row_number() over (partition by question, fund order by rank) as rn from (
    select *, count(*) over (partition by question) as n from {name}_ranked_v where score >= 0.3) where n >= 3"""
    VIEWS[f"{name}_walk2_v"] = f"""
  select question, fund, rn, score as last_kept, true as kept from {name}_steps2_v where rn = 1
  union all
  select s.question, s.fund, s.rn,
    case when abs(s.score - w.last_kept) >= 0.05 then s.score else w.last_kept end, abs(s.score - w.last_kept) >= 0.05
  from {name}_walk2_v w join {name}_steps2_v s on s.question = w.question and s.fund = w.fund and s.rn = w.rn + 1"""
    VIEWS[f"{name}_found_v"] = f"""
  select question, string_agg('=== Chunk ' || no || ' (Fund: ' || fund || ', Source: ' || namespace || ', Relevance: '
      || format('{{:.2f}}', score) || ') ===' || chr(10) || text || chr(10), chr(10) order by no) as context
  from (select s.*, row_number() over (partition by s.question order by s.rank) as no
    from {name}_steps2_v s join {name}_walk2_v w using (question, fund, rn) where w.kept) group by question"""


_search_views("specific", "specific_v")
_search_views("asked", "all_asked_v")


def index(spark, sf_dir):
    """The stored vectors of every fund's chunks, built once for the query."""
    path = scratch_path(spark, "index")
    vt.publish(vt.to_vectors(chunking.fund_chunks(spark, sf_dir)), path, [fv.HOLDINGS, fv.TRADES])
    return vt.published(spark, path)


@query("r7_retrieved_contexts", f"""
select question_id, md5(context) as digest, length(context) as chars,
  case when context is null then '{fv.REFUSAL}' end as error
from routed_v left join asked_found_v using (question)""")
def retrieved_contexts(spark, sf_dir):
    found = ab.retrieve_and_validate(views.questions(spark, sf_dir), index(spark, sf_dir))
    return found.select("question_id", F.md5("context").alias("digest"),
                        F.char_length("context").cast("bigint").alias("chars"), "error")


_GATHERED = f"""
  select question_id, question, query_type, context, null as error from aggregated_v
  union all
  select question_id, question, query_type, context, case when context is null then '{fv.REFUSAL}' end
  from routed_v left join specific_found_v using (question) where query_type = 'specific'"""


def gathered(spark, sf_dir):
    return ab.gather_contexts(
        views.questions(spark, sf_dir), index(spark, sf_dir),
        views.holdings(spark, sf_dir, securities=False), views.trades(spark, sf_dir))


@query("r12_gathered_contexts", f"select question_id, query_type, md5(context) as digest, error from ({_GATHERED})")
def gathered_contexts(spark, sf_dir):
    return gathered(spark, sf_dir).select("question_id", "query_type", F.md5("context").alias("digest"), "error")


def _echo():
    """Stands in for a generator: says how long the prompt is, fails on some."""

    def ask(prompt):
        if len(prompt) % 10 == 7:
            raise RuntimeError("quota of the day is used up")
        return f"\t The prompt has {len(prompt)} characters.\r\n"

    return ask


_LENGTHS = f"""
select question_id, query_type, context, error, length(context) + length(question)
  + case query_type when 'aggregation' then {len(fv.AGGREGATION_PROMPT) - len("{context}{question}")}
                    else {len(fv.RETRIEVAL_PROMPT) - len("{context}{question}")} end as chars
from ({_GATHERED})"""
_RESULTS = f"""
select question_id, case when error is null then query_type else '' end as query_type,
  md5(case when error is null then context else '' end) as digest,
  case when error is not null then error
       when chars % 10 = 7 then 'Error generating answer: quota of the day is used up'
       else 'The prompt has ' || chars || ' characters.' end as answer, error
from ({_LENGTHS})"""


_CLEAN_PROMPT = len(fv.SYSTEM_PROMPT) - len("{context}{question}")


@query("s11_plain_answers", f"""
select question_id, error, md5(case when error is null then context else '' end) as digest,
  case when error is not null then error
       when chars % 10 = 7 then '{fv.RATE_LIMIT_MESSAGE}'
       when chars % 10 = 3 then '{fv.REFUSAL}'
       else chr(9) || ' The prompt has ' || chars || ' characters.' || chr(13) || chr(10) end as answer
from (select question_id, context, case when context is null then '{fv.REFUSAL}' end as error,
    length(context) + length(question) + {_CLEAN_PROMPT} as chars
  from routed_v left join asked_found_v using (question))""")
def plain_answers(spark, sf_dir):
    """Every question by search alone; answers that are too short give way to the refusal."""
    done = pr.answers(views.questions(spark, sf_dir), index(spark, sf_dir), _short_echo)
    return done.select("question_id", F.md5("context").alias("digest"), "answer", "error")


def _short_echo():
    ask = _echo()
    return lambda prompt: " no " if len(prompt) % 10 == 3 else ask(prompt)


@query("s11_replies", f"select question_id, answer, case when query_type = '' then '' else query_type end as query_type, error from ({_RESULTS})")
def replies(spark, sf_dir):
    """The batch's answers as they leave the service."""
    return pr.replies(ab.results(ab.generate(ab.prompts(gathered(spark, sf_dir)), _echo)))


@query("u3_generator_hook", _RESULTS)
@query("s11_batch_results", _RESULTS)
def batch_results(spark, sf_dir):
    done = ab.results(ab.generate(ab.prompts(gathered(spark, sf_dir)), _echo))
    return done.select("question_id", "query_type", F.md5("context").alias("digest"), "answer", "error")
