"""Routing, text clean-up and answer-scoring queries."""

import hashlib

from pyspark.sql import functions as F

from fundweave import fixed_values as fv
from fundweave.functions import answers as an, routing, text as tx
from fundweave.operators import context as cx, evaluate as ev, stats
from fundweave.plans import answer_batch as ab
from fundweave.session import scratch_path
from fundweave.workload import funds, views
from fundweave.workload.catalog import VIEWS, query

_PATTERNS = "|".join(fv.AGGREGATION_PATTERNS)
_PL = "|".join(fv.PL_WORDS)
_TRADE = "|".join(fv.TRADE_WORDS)
_HOLDING = "|".join(fv.HOLDING_WORDS)

VIEWS["routed_v"] = f"""
  select *, case when regexp_matches(lower(question), '{_PATTERNS}') then 'aggregation' else 'specific' end as query_type,
    regexp_matches(lower(question), '{_PL}') as need_pl,
    case when regexp_matches(lower(question), '{_HOLDING}') then 'holdings'
         when regexp_matches(lower(question), '{_TRADE}') then 'trades'
         when regexp_matches(lower(question), '{_PL}') then 'holdings' end as namespace,
    contains(lower(question), 'total') and contains(lower(question), 'cash') as wants_cash
  from questions_v"""


def routed(spark, sf_dir):
    return routing.route(views.questions(spark, sf_dir))


@query("q1_query_type", "select question_id, query_type from routed_v")
def query_type(spark, sf_dir):
    return routed(spark, sf_dir).select("question_id", "query_type")


@query("q2_profit_filter", "select question_id, need_pl from routed_v")
def profit_filter(spark, sf_dir):
    return routed(spark, sf_dir).select("question_id", "need_pl")


@query("q3_namespace", "select question_id, namespace from routed_v")
def namespace(spark, sf_dir):
    return routed(spark, sf_dir).select("question_id", "namespace")


@query("q4_wants_cash", "select question_id, wants_cash from routed_v")
def wants_cash(spark, sf_dir):
    return routed(spark, sf_dir).select("question_id", "wants_cash")


@query("q5_router_bypass", """
select question_id, query_type, false as need_pl, null::varchar as namespace from routed_v""")
def router_bypass(spark, sf_dir):
    return routing.route(views.questions(spark, sf_dir), auto_classify=False).select(
        "question_id", "query_type", "need_pl", "namespace")


# Conversation turns are free text of any length: the same rules over whole turns.
@query("q1_conversation_turns", f"""
select conv_id, turn, case when regexp_matches(lower(text), '{_PATTERNS}') then 'aggregation' else 'specific' end as query_type,
  regexp_matches(lower(text), '{_PL}') as need_pl,
  case when regexp_matches(lower(text), '{_HOLDING}') then 'holdings'
       when regexp_matches(lower(text), '{_TRADE}') then 'trades'
       when regexp_matches(lower(text), '{_PL}') then 'holdings' end as namespace
from conversations""")
def conversation_turns(spark, sf_dir):
    turns = views.table(spark, sf_dir, "conversations").withColumnRenamed("text", "question")
    return routing.route(turns).select("conv_id", "turn", "query_type", "need_pl", "namespace")


def aggregated(spark, sf_dir):
    return cx.attach_aggregates(
        routed(spark, sf_dir).filter("query_type = 'aggregation'"), funds.contexts(spark, sf_dir))


VIEWS["aggregated_v"] = """
  select question_id, question, query_type, context
  from routed_v join contexts_v using (wants_cash) where query_type = 'aggregation'"""


@query("j5_aggregates_per_question", """
select question_id, length(context) as chars, md5(context) as digest from aggregated_v""")
def aggregates_per_question(spark, sf_dir):
    return aggregated(spark, sf_dir).select(
        "question_id", F.char_length("context").cast("bigint").alias("chars"), F.md5("context").alias("digest"))


def _sql_template(template, context, question):
    before, rest = template.replace("'", "''").split("{context}")
    middle, after = rest.split("{question}")
    return f"'{before}' || {context} || '{middle}' || {question} || '{after}'"


_AGG_PROMPT = _sql_template(fv.AGGREGATION_PROMPT, "context", "question")
_RAG_PROMPT = _sql_template(fv.RETRIEVAL_PROMPT, "context", "question")


@query("c10_prompts", f"""
select question_id, length({_AGG_PROMPT}) as chars, md5({_AGG_PROMPT}) as digest from aggregated_v""")
def aggregation_prompts(spark, sf_dir):
    built = ab.prompts(aggregated(spark, sf_dir))
    return built.select("question_id", F.char_length("prompt").cast("bigint").alias("chars"), F.md5("prompt").alias("digest"))


def keyed(spark, sf_dir):
    """Aggregation questions with the key of their context, and its stored lines."""
    return ab.gather_keyed(
        views.questions(spark, sf_dir), None, funds._held(spark, sf_dir), funds._traded(spark, sf_dir), scratch_path(spark, "context"))


@query("j5_keyed_contexts", """
select question_id, context_key, chars from routed_v join context_keys_v using (wants_cash) where query_type = 'aggregation'""")
def keyed_contexts(spark, sf_dir):
    return keyed(spark, sf_dir)[0].select("question_id", "context_key", "chars")


def _digest(prompt):
    return hashlib.md5(prompt.encode()).hexdigest()


@query("c10_rendered_prompts", f"select question_id, md5({_AGG_PROMPT}) as digest from aggregated_v")
def rendered_prompts(spark, sf_dir):
    """The prompts as a generator gets them, from stored lines of the context."""
    asked, lines = keyed(spark, sf_dir)
    return ab.generate(ab.prompts(asked), lambda: _digest, lines=lines).select("question_id", F.col("answer").alias("digest"))


@query("c10_document_prompts", f"""
select doc_id, md5({_sql_template(fv.RETRIEVAL_PROMPT, "text", "source")}) as retrieval,
  md5({_sql_template(fv.SYSTEM_PROMPT, "text", "source")}) as system
from documents""")
def document_prompts(spark, sf_dir):
    """Whole documents, some with braces, as contexts: values must not be treated as places."""
    return views.document_table(spark, sf_dir).select(
        "doc_id",
        F.md5(cx.prompt(F.lit("specific"), F.col("text"), F.col("source"))).alias("retrieval"),
        F.md5(cx.system_prompt(F.col("text"), F.col("source"))).alias("system"),
    )


def controlled(spark, sf_dir):
    """Documents with control characters put before every blank and around the text."""
    return views.document_table(spark, sf_dir).select(
        "doc_id",
        F.concat(
            F.lit("\t \r\n"), F.replace("text", F.lit(" "), F.lit("\t\x7f\x85 \r")), F.lit("\x0b\x01 \n")
        ).alias("text"),
    )


VIEWS["controlled_v"] = """
  select doc_id, chr(9) || ' ' || chr(13) || chr(10)
    || replace(text, ' ', chr(9) || chr(127) || chr(133) || ' ' || chr(13)) || chr(11) || chr(1) || ' ' || chr(10) as text
  from documents"""
_WHITE = r"[\s\x{0B}\x{1C}-\x{1F}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"
_CLEANED = (
    r"regexp_replace(regexp_replace(text, '[\x00-\x09\x0B-\x1F\x7F]', '', 'g'), "
    rf"'^{_WHITE}|{_WHITE}$', '', 'g')"
)


@query("c11_clean_answers", f"select doc_id, length({_CLEANED}) as chars, md5({_CLEANED}) as digest from controlled_v")
def clean_answers(spark, sf_dir):
    cleaned = controlled(spark, sf_dir).withColumn("clean", tx.clean_answer(F.col("text")))
    return cleaned.select("doc_id", F.char_length("clean").cast("bigint").alias("chars"), F.md5("clean").alias("digest"))


_REPLY = rf"regexp_replace({_CLEANED}, '[\x00-\x08\x0B-\x0C\x0E-\x1F\x7F-\x{{9F}}]', '', 'g')"


@query("c12_clean_replies", f"select doc_id, length({_REPLY}) as chars, md5({_REPLY}) as digest from controlled_v")
def clean_replies(spark, sf_dir):
    cleaned = controlled(spark, sf_dir).withColumn("clean", tx.clean_reply(tx.clean_answer(F.col("text"))))
    return cleaned.select("doc_id", F.char_length("clean").cast("bigint").alias("chars"), F.md5("clean").alias("digest"))


# --- answers: computed values, every second one wrong, some refused, some too short ---

def expected(spark, sf_dir):
    """The number or fund name each question's answer has to mention."""
    held = stats.holdings_by_fund(views.holdings(spark, sf_dir, securities=False)).select(
        F.col("PortfolioName").alias("asked_fund"), "holdings_count")
    asked = views.questions(spark, sf_dir)
    return asked.join(held, "asked_fund").select(
        "question_id", F.col("holdings_count").cast("string").alias("expected"))


def answers(spark, sf_dir):
    number = F.when(F.col("question_id") % 2 == 1, F.lit("-1")).otherwise(F.col("expected"))
    return expected(spark, sf_dir).select(
        "question_id",
        F.when(F.col("question_id") % 7 == 0, F.lit("Sorry, I CANNOT FIND the answer in the provided data"))
        .when(F.col("question_id") % 11 == 0, F.lit("  short \n"))
        .when(F.col("question_id") % 13 == 0, F.lit(None).cast("string"))
        .otherwise(F.concat(F.lit("The fund has "), number, F.lit(" holdings."))).alias("answer"),
    )


VIEWS["expected_v"] = """
  select question_id, cast(holdings_count as varchar) as expected
  from questions_v join held_v on asked_fund = PortfolioName"""
VIEWS["answers_v"] = """
  select question_id, case when question_id % 7 = 0 then 'Sorry, I CANNOT FIND the answer in the provided data'
    when question_id % 11 = 0 then '  short ' || chr(10) when question_id % 13 = 0 then null
    else 'The fund has ' || case when question_id % 2 = 1 then '-1' else expected end || ' holdings.' end as answer
  from expected_v"""
_VALID = r"""(contains(lower(answer), 'sorry') and contains(lower(answer), 'cannot find'))
  or length(regexp_replace(answer, '^\s+|\s+$', '', 'g')) >= 10"""


@query("c13_valid_answers", f"select question_id, {_VALID} as valid from answers_v")
def valid_answers(spark, sf_dir):
    return answers(spark, sf_dir).select("question_id", an.is_valid_answer(F.col("answer")).alias("valid"))


@query("c14_refusals", f"""
select question_id, case when {_VALID} then answer else '{fv.REFUSAL}' end as answer from answers_v""")
def refusals(spark, sf_dir):
    answer = F.col("answer")
    return answers(spark, sf_dir).select(
        "question_id", an.or_refusal(answer, an.is_valid_answer(answer)).alias("answer"))


def _failures(spark, sf_dir):
    kind = F.col("event_id") % 4
    return views.table(spark, sf_dir, "events").select(
        "event_id",
        F.when(kind == 0, F.concat(F.lit("429 Quota exceeded for "), "event_type"))
        .when(kind == 1, F.concat(F.lit("Rate Limit hit by "), "event_type"))
        .when(kind == 2, F.concat(F.lit("Bad API key in "), "props"))
        .when(F.col("event_type") != "error", F.concat(F.lit("timeout after "), F.col("event_type"))).alias("error"),
    )


@query("c15_failures", f"""
with failed as (select event_id, case when event_id % 4 = 0 then '429 Quota exceeded for ' || event_type
    when event_id % 4 = 1 then 'Rate Limit hit by ' || event_type when event_id % 4 = 2 then 'Bad API key in ' || props
    when event_type <> 'error' then 'timeout after ' || event_type end as error from events)
select event_id, case when error is null then null when lower(error) like '%quota%' or lower(error) like '%rate limit%'
    then 'rate_limit' when lower(error) like '%api key%' then 'api_key' else 'other' end as category,
  case when error is null then null when lower(error) like '%quota%' or lower(error) like '%rate limit%'
    then '{fv.RATE_LIMIT_MESSAGE}' when lower(error) like '%api key%' then '{fv.API_KEY_MESSAGE}'
    else '❌ {fv.GENERATION_FAILED}' || error end as message
from failed""")
def failures(spark, sf_dir):
    error = F.col("error")
    return _failures(spark, sf_dir).select(
        "event_id", an.failure_category(error).alias("category"), an.failure_message(error).alias("message"))


_SORRY = "regexp_matches(lower(answer), 'sorry|cannot find')"


@query("e1_answered", f"select question_id, not {_SORRY} as passed from answers_v")
def answered(spark, sf_dir):
    return answers(spark, sf_dir).select("question_id", ev.answered(F.col("answer")).alias("passed"))


@query("e2_refused", f"select question_id, {_SORRY} as passed from answers_v")
def refused(spark, sf_dir):
    return answers(spark, sf_dir).select("question_id", ev.refused(F.col("answer")).alias("passed"))


_MENTIONS = "select question_id, coalesce(contains(answer, expected), false) as passed from answers_v join expected_v using (question_id)"


def _mentions(spark, sf_dir):
    return ev.mentions_expected(answers(spark, sf_dir), expected(spark, sf_dir))


@query("e3_mentions_expected", _MENTIONS)
def mentions_expected(spark, sf_dir):
    return _mentions(spark, sf_dir).select("question_id", "passed")


VIEWS["top_answers_v"] = """
  select question_id, case when question_id % 5 = 0 then null when question_id % 3 = 0 then 'The best fund is ' || top || '.'
    else 'It is ' || asked_fund || '.' end as answer, top as expected
  from routed_v,
    (select PortfolioName as top from held_v order by pl_ytd desc, PortfolioName limit 1)
  where query_type = 'aggregation'"""


@query("e3_mentions_top_fund", "select question_id, coalesce(contains(answer, expected), false) as passed from top_answers_v")
def mentions_top_fund(spark, sf_dir):
    """Answers to ranking questions have to name the fund that is really the best."""
    asked = routed(spark, sf_dir).filter("query_type = 'aggregation'")
    wanted = ev.top_fund_expected(asked, stats.holdings_by_fund(views.holdings(spark, sf_dir, securities=False)))
    number = F.col("question_id")
    given = asked.join(wanted, "question_id").select("question_id", F.when(number % 5 == 0, F.lit(None)).when(
        number % 3 == 0, F.concat(F.lit("The best fund is "), "expected", F.lit("."))).otherwise(
        F.concat(F.lit("It is "), "asked_fund", F.lit("."))).alias("answer"))
    return ev.mentions_expected(given, wanted).select("question_id", "passed")


@query("j7_expected_values", "select question_id, answer, expected from answers_v join expected_v using (question_id)")
def expected_values(spark, sf_dir):
    return _mentions(spark, sf_dir).select("question_id", "answer", "expected")


_SUMMARY = f"""
select count(*) as total_tests, count(*) filter (passed) as passed_tests, count(*) filter (not passed) as failed_tests,
  count(*) filter (passed) / count(*) * 100 as pass_rate,
  case when count(*) filter (passed) = count(*) then 'all passed'
       when count(*) filter (passed) / count(*) * 100 >= 80 then 'mostly passed' else 'many failed' end as band
from ({_MENTIONS})"""


@query("a17_pass_totals", _SUMMARY)
@query("e5_pass_bands", _SUMMARY)
def pass_totals(spark, sf_dir):
    return ev.pass_summary(_mentions(spark, sf_dir))


@query("e6_namespace_checks", """
select question_id, namespace is null or namespace = 'holdings' as passed from routed_v""")
def namespace_checks(spark, sf_dir):
    return routed(spark, sf_dir).select(
        "question_id", ev.namespace_passes(F.col("namespace"), F.lit(fv.HOLDINGS)).alias("passed"))
