"""The registered queries of the compression engine and their SQL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ctxpress.functions import patterns as P
from ctxpress.functions import scoring as S
from ctxpress.functions.content import ENTITY_LINE, INSTRUCTION_LINE, MATCH_CAP, SCORES, SIGNALS, STRUCTURED, THRESHOLD, content_profile, heading_depth, json_depth, line_share, xml_depth, yaml_depth
from ctxpress.functions.text import paragraphs, sentence_count, split_sentences, token_count
from ctxpress.operators import metrics, validation
from ctxpress.operators.compress import compress, compress_chat
from ctxpress.operators.cost import PRICES, savings_summary, with_savings
from ctxpress.operators.modes import BY_TYPE, MODES, mode_of, modes
from ctxpress.operators.rewrite import CallableProvider, rewrite
from ctxpress.operators.selection import knapsack_select
from ctxpress.operators.structured import optimize_structured


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def _spread(df: DataFrame) -> DataFrame:
    """A table of fewer files than cores (its row groups may all lie in one) is dealt out before dear work; others stay."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(4 * cores) if len(df.inputFiles()) < cores else df


#: Prompts with directives, labels, lists, paths and code, built from orders alike in Spark and in the oracle: the text tables hold none.
PROMPT_SQL = """
select o_orderkey as prompt_id, concat(
  case o_orderstatus when 'F' then 'You must verify order ' when 'O' then 'Please confirm order ' else 'Never change order ' end,
  cast(o_orderkey as string), ' of customer C-', cast(o_custkey as string), ' before release v1.', cast(o_orderkey % 7 as string), '.2.',
  case substr(o_orderpriority, 1, 1)
    when '1' then concat(chr(10), 'WARNING: the account is blocked.')
    when '2' then ' Respond in JSON with `order_id` only.'
    when '3' then concat(chr(10), '- call /api/v1/orders/', cast(o_orderkey as string), chr(10), '- use ORDER_KEY')
    when '4' then concat(chr(10), chr(10), 'Is waiting within 5 days harmful?')
    else ' The quick parcel went out e.g. Monday and came back by noon.' end) as text
from orders"""


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _spread(_read(spark, sf_dir, "documents").select("doc_id", "text"))


def prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    _read(spark, sf_dir, "orders").createOrReplaceTempView("ctxpress_orders")
    return _spread(spark.sql(PROMPT_SQL.replace("from orders", "from ctxpress_orders")))


def token_stats_by_lang(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("lang", "source", token_count(F.col("text")).cast("long").alias("n"))
    return docs.groupBy("lang", "source").agg(F.count(F.lit(1)).alias("n_docs"), F.sum("n").alias("n_tokens"), F.max("n").alias("max_tokens"))


_TOKENS = "case when coalesce(length({0}), 0) = 0 then 0 else greatest(1, cast(round_even({0_len} / 4, 0) as bigint)) end"


def _tokens_sql(text: str) -> str:
    return f"case when coalesce(length({text}), 0) = 0 then 0 else greatest(1, cast(round_even(length({text}) / 4, 0) as bigint)) end"


def cost_savings_by_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What halving each document's tokens saves, by model."""
    docs = _read(spark, sf_dir, "documents").select("lang", token_count(F.col("text")).cast("long").alias("n"))
    sums = docs.groupBy("lang").agg(F.sum("n").alias("original_tokens"), F.sum(F.floor(F.col("n") / 2)).alias("compressed_tokens"))
    return with_savings(sums).select("lang", "model", "original_tokens", "compressed_tokens", "tokens_saved", F.round("daily_savings", 2).alias("daily_savings"))


def paragraph_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = prompts(spark, sf_dir)
    return own.select("prompt_id", F.size(paragraphs(F.col("text"))).cast("long").alias("n_paragraphs"))


def sentence_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir)
    return docs.select("doc_id", sentence_count(F.col("text")).alias("n_sentences"))


def prompt_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = prompts(spark, sf_dir).select("prompt_id", F.posexplode(split_sentences(F.col("text"))).alias("idx", "x"))
    return own.select("prompt_id", F.col("idx").cast("long").alias("idx"), F.col("x.s").alias("sentence"))


def instruction_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prompts(spark, sf_dir).select("prompt_id", F.round(S.instruction_score(F.col("text")), 6).alias("instruction_score"))


def must_keep(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prompts(spark, sf_dir).select("prompt_id", S.must_keep(F.col("text"), ("customer c-1\\d*5 ",)).alias("must_keep"))


def sentence_priority(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tier of each prompt's text and its entities (a text with any entity has at least 0.3)."""
    return prompts(spark, sf_dir).select("prompt_id", S.priority(F.col("text")).cast("long").alias("tier"))


def entity_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = prompts(spark, sf_dir)
    return own.select("prompt_id", S.entity_count(F.col("text")).cast("long").alias("n_entities"), F.round(S.entity_score(F.col("text")), 6).alias("entity_score"))


def document_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entities of each whole document."""
    own = _documents(spark, sf_dir).withColumn("n", S.entity_count(F.col("text")))
    return own.select("doc_id", F.col("n").cast("long").alias("n_entities"), F.round(S.entity_score(F.col("text"), F.col("n")), 6).alias("entity_score"))


def retention_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document against its compressed text."""
    done = metrics.quality(compress(_documents(spark, sf_dir)))
    return done.select("doc_id", "original_tokens", "compressed_tokens", "quality.*")


def average_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean quality by language and target ratio (a sweep over three ratios)."""
    docs = _spread(_read(spark, sf_dir, "documents").select("doc_id", "lang", "text"))
    sweep = [metrics.quality(compress(docs, target_ratio=r)).withColumn("ratio", F.lit(r)).select("lang", "ratio", "quality") for r in (0.3, 0.5, 0.7)]
    return metrics.averages(sweep[0].unionByName(sweep[1]).unionByName(sweep[2]), "lang", "ratio")


def word_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Word sets of each prompt against a shorter wording of it."""
    own, a, b = rewordings(spark, sf_dir), F.col("text"), F.col("other")
    return own.select("prompt_id", F.round(metrics.jaccard(a, b), 6).alias("jaccard"), F.round(metrics.rouge1(a, b), 6).alias("rouge1"), F.round(metrics.overlap(a, b), 6).alias("overlap"))


REWORDING = "replace(replace(replace(text, ' of customer', ''), 'e.g. Monday', 'early'), 'You must', 'Must')"


def rewordings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prompts(spark, sf_dir).withColumn("other", F.expr(REWORDING))


def bleu4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rewordings(spark, sf_dir).select("prompt_id", F.round(metrics.bleu4(F.col("text"), F.col("other")), 3).alias("bleu4"))


def rouge_l(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rewordings(spark, sf_dir).select("prompt_id", F.round(metrics.rouge_l(F.col("text"), F.col("other")), 4).alias("rouge_l"))


def validate_rewrite(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shares of instructions, entities and keywords that a shorter wording keeps, and its size."""
    own, v = rewordings(spark, sf_dir), validation.validate(F.col("text"), F.col("other"), ("order",))
    return own.select(
        "prompt_id", F.round(v["instruction_retention"], 6).alias("instruction_retention"), F.round(v["entity_retention"], 6).alias("entity_retention"),
        F.round(v["token_reduction"], 4).alias("token_reduction"), F.round(v["keyword_retention"], 4).alias("keyword_retention"),
    )


def rewrite_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All prompts through a provider (here a plain function) and its checks."""
    provider = CallableProvider(lambda text, ratio: text.replace(" of customer", "").replace("You must", "Must"))
    done = rewrite(prompts(spark, sf_dir), provider, keywords=("order",))
    return done.select("prompt_id", "accepted", "rewritten_text", "validation.similarity", "validation.failures")


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, text) of all documents, pages, prompts and event properties."""
    kinds = [
        _read(spark, sf_dir, "documents").select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("id"), "text"),
        _read(spark, sf_dir, "pages").select(F.concat(F.lit("h"), F.col("page_id").cast("string")).alias("id"), F.col("html").alias("text")),
        prompts(spark, sf_dir).select(F.concat(F.lit("p"), F.col("prompt_id").cast("string")).alias("id"), "text"),
        _read(spark, sf_dir, "events").select(F.concat(F.lit("e"), F.col("event_id").cast("string")).alias("id"), F.col("props").alias("text")),
    ]
    return _spread(reduce(DataFrame.unionByName, kinds))


def content_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Content type, confidence and mode of every text."""
    p = F.col("profile")
    done = content_profile(texts(spark, sf_dir), brief=True)
    return done.select("id", p["content_type"].alias("content_type"), p["confidence"].alias("confidence"), p["has_structure"].alias("has_structure"), mode_of(p["content_type"]).alias("mode"))


def structure_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    own, x = texts(spark, sf_dir), F.col("text")
    return own.select("id", *(f(x).cast("long").alias(k) for k, f in (("json_depth", json_depth), ("xml_depth", xml_depth), ("yaml_depth", yaml_depth), ("heading_depth", heading_depth))))


def line_densities(spark: SparkSession, sf_dir: str) -> DataFrame:
    own, x = prompts(spark, sf_dir), F.col("text")
    return own.select("prompt_id", line_share(x, INSTRUCTION_LINE, "i").alias("instruction_density"), line_share(x, ENTITY_LINE).alias("entity_density"))


def mode_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return modes(spark).select("mode", "target_ratio", F.size("weights").cast("long").alias("n_weights"), "preserve_structure")


def optimize_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event properties as dense JSON."""
    own = _spread(_read(spark, sf_dir, "events").select("event_id", "props"))
    return own.select("event_id", optimize_structured(F.lit("json"), F.col("props"), F.lit(1.0)).alias("dense"))


def optimize_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages through the XML path (null: not well-formed)."""
    return _spread(_read(spark, sf_dir, "pages")).select("page_id", optimize_structured(F.lit("html"), F.col("html"), F.lit(0.5)).alias("short"))


def compress_auto(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text by the mode of its content type."""
    done = compress(texts(spark, sf_dir), detect_content=True)
    return done.select("id", "mode", "content_type", "target_ratio", "structure_preserved", "original_tokens", "compressed_tokens", "entities_found", "entities_kept", "instructions_found", "instructions_kept")


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chunks of every document and what is left of each."""
    done = compress(_documents(spark, sf_dir)).select("doc_id", F.posexplode("chunk_results").alias("chunk", "x"))
    return done.select("doc_id", F.col("chunk").cast("long").alias("chunk"), "x.*")


def knapsack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each order the lines of the greatest price within half of its quantity."""
    lines = _read(spark, sf_dir, "lineitem").select("l_orderkey", F.struct(F.col("l_linenumber").alias("k"), F.col("l_quantity").cast("int").alias("tokens"), F.col("l_extendedprice").alias("score"), F.lit(False).alias("must_keep")).alias("x"))
    own = lines.groupBy("l_orderkey").agg(F.array_sort(F.collect_list("x")).alias("x"))
    picked = own.withColumn("kept", knapsack_select(F.transform("x", lambda r: F.struct(r["tokens"].alias("tokens"), r["score"].alias("score"), r["must_keep"].alias("must_keep")))))
    value = F.aggregate("kept", F.lit(0.0), lambda acc, i: acc + F.get("x", i)["score"])
    return picked.select("l_orderkey", F.round(value, 2).alias("value"))


def corpus_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens before and after compression by language and source, and above them."""
    docs = _spread(_read(spark, sf_dir, "documents").select("lang", "source", "text"))
    return metrics.totals(compress(docs), "lang", "source")


def compression_savings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the compressed documents save, by model."""
    done = compress(_documents(spark, sf_dir)).agg(F.sum("original_tokens").alias("original_tokens"), F.sum("compressed_tokens").alias("compressed_tokens"))
    return with_savings(done).select("model", "original_tokens", "compressed_tokens", "tokens_saved", "reduction_percent", "daily_savings", savings_summary().alias("summary"))


_RESULT = ("original_tokens", "compressed_tokens", "sentences_total", "sentences_kept", "num_chunks", "target_ratio", "actual_ratio", "reduction_percent", "compressed_text")


def compress_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compress(_documents(spark, sf_dir)).select("doc_id", *_RESULT)


def compress_documents_with_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compress(_documents(spark, sf_dir), target_ratio=0.3, query="tion thing ther que des nicht").select("doc_id", *_RESULT)


def compress_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compress(prompts(spark, sf_dir), min_tokens=10).select("prompt_id", *_RESULT)


def compress_chat_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compress_chat(_read(spark, sf_dir, "conversations")).select("conv_id", "turn", "role", "compressed_text")


QUERIES = {
    "token_stats_by_lang": token_stats_by_lang,
    "cost_savings_by_model": cost_savings_by_model,
    "paragraph_counts": paragraph_counts,
    "sentence_counts": sentence_counts,
    "prompt_sentences": prompt_sentences,
    "instruction_scores": instruction_scores,
    "must_keep": must_keep,
    "sentence_priority": sentence_priority,
    "entity_scores": entity_scores,
    "retention_metrics": retention_metrics,
    "compress_documents": compress_documents,
    "compress_documents_with_query": compress_documents_with_query,
    "compress_prompts": compress_prompts,
    "compress_chat": compress_chat_turns,
    **{f.__name__: f for f in (
        document_entities, average_quality, word_similarity, bleu4, rouge_l, validate_rewrite, rewrite_verdicts, content_types, structure_depth, line_densities,
        mode_table, optimize_json, optimize_pages, compress_auto, chunks, knapsack, corpus_totals, compression_savings,
    )},
}

_PROMPTS = f"with p as ({PROMPT_SQL})"
_any = lambda patterns: "(?im)" + "|".join(f"(?:{p})" for p in patterns).replace("'", "''")
_prices = ", ".join(f"('{m}', {i}::double)" for m, (i, _) in PRICES.items())
_CODE = P.CODE_SPAN
_set = "list_distinct(list_filter(regexp_split_to_array(lower(coalesce({0}, '')), '[\\s\\x0b\\x1c-\\x1f\\x{{85}}\\x{{a0}}\\x{{2028}}\\x{{2029}}]+'), lambda w: w <> ''))"
_entity_any = "|".join(f"(?:{'(?i:' + p + ')' if 'i' in f else p})" for f, p in P.ENTITY).replace("'", "''")

_TEXTS = f"""{_PROMPTS},
t as (select 'd' || doc_id as id, text from documents union all select 'h' || page_id, html from pages union all select 'p' || prompt_id, text from p union all select 'e' || event_id, props from events)"""


def _content_sql() -> str:
    """The scores over figures that the other engine counts with its own regular expressions."""
    quote = lambda x: x.replace("'", "''")
    flags = lambda f: f"(?{f})" if f else ""
    counted = ", ".join(f"least(len(regexp_extract_all(text, '{quote(flags(f) + p)}')), {MATCH_CAP}) as {k}" for k, (f, p) in SIGNALS.items())
    chars = lambda c: " + ".join(f"(length(text) - length(replace(text, '{x}', '')))" for x in c)
    blank = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
    ranked = ", ".join(f"{{'score': least({e}, 1e0), 'turn': {-i}, 'name': '{k}'}}" for i, (k, e) in enumerate(SCORES.items()))
    pairs = ", ".join(f"'{k}': '{v}'" for k, v in BY_TYPE.items())
    kinds = ", ".join(f"'{k}'" for k in STRUCTURED)
    return f"""{_TEXTS},
f as (select id, {counted}, len(list_filter(string_split(text, chr(10)), lambda l: trim(l, {blank}) <> '')) as n_lines, left(trim(text, {blank}), 1) as first_char, right(trim(text, {blank}), 1) as last_char,
  length(trim(text, {blank})) as n_stripped, {chars('{}')} as n_curly, {chars('[]')} as n_square, {chars(';')} as n_semicolon, {chars('()')} as n_paren,
  len(list_filter(string_split(text, chr(10)), lambda l: starts_with(l, '    '))) as n_indented, len(list_filter(string_split(text, chr(10) || chr(10)), lambda l: trim(l, {blank}) <> '')) as n_paragraphs,
  len(list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> '')) as n_words from t),
r as (select id, n_stripped, list_sort([{ranked}], 'DESC') as r from f),
b as (select id, n_stripped, r, r[1].score as best, case when n_stripped = 0 or r[1].score < {THRESHOLD}e0 then 'general_text' else r[1].name end as kind from r)
select id, kind as content_type, case when n_stripped = 0 then 1e0 else round_even(case when best < {THRESHOLD}e0 then 1e0 - best else best end, 4) end as confidence,
  kind in ({kinds}) or len(list_filter(list_filter(r, lambda x: n_stripped > 0 and x.score >= {THRESHOLD}e0 and x.name <> kind)[1:3], lambda x: x.name in ({kinds}))) > 0 as has_structure,
  map {{{pairs}}}[kind] as mode from b"""


def _densities_sql() -> str:
    share = lambda p: f"round_even(len(list_filter(l, lambda x: regexp_matches(x, '{p}'))) / greatest(len(l), 1), 4)".replace("don't", "don''t")
    return f"""{_PROMPTS}, q as (select prompt_id, list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '') as l from p)
select prompt_id, {share('(?i)' + INSTRUCTION_LINE)} as instruction_density, {share(ENTITY_LINE)} as entity_density from q"""


def _validate_sql() -> str:
    inst = ("(?im)" + "|".join(f"(?:{p})" for p in validation.INSTRUCTION)).replace("'", "''")
    ent = ", ".join("regexp_extract_all(text, '{}')".format((("(?i)" if "i" in f else "") + p).replace("'", "''")) for f, p in validation.ENTITY)
    share = lambda x, of: f"case when len({x}) = 0 then 1e0 else len(list_filter({x}, lambda w: contains({of}, w))) / len({x}) end"
    return f"""{_PROMPTS}, q as (select *, {REWORDING} as other from p),
m as (select *, list_distinct(list_transform(regexp_extract_all(text, '{inst}'), lambda w: lower(trim(w)))) as i, list_distinct(flatten([{ent}])) as e from q)
select prompt_id, round({share('i', 'lower(other)')}, 6) as instruction_retention, round({share('e', 'other')}, 6) as entity_retention,
  round(round_even({_tokens_sql('other')} / greatest({_tokens_sql('text')}, 1), 4), 4) as token_reduction, case when contains(lower(other), 'order') then 1e0 else 0e0 end as keyword_retention from m"""


ORACLE_SQL = {
    "token_stats_by_lang": f"select lang, source, count(*) as n_docs, sum({_tokens_sql('text')})::bigint as n_tokens, max({_tokens_sql('text')})::bigint as max_tokens from documents group by all",
    "cost_savings_by_model": f"""
with d as (select lang, {_tokens_sql('text')} as n from documents),
s as (select lang, sum(n)::bigint as original_tokens, sum(n // 2)::bigint as compressed_tokens from d group by lang)
select lang, model, original_tokens, compressed_tokens, original_tokens - compressed_tokens as tokens_saved,
  round(round((original_tokens - compressed_tokens) * 1000 / 1000 * price, 4), 2) as daily_savings
from s, (values {_prices}) as m(model, price)""",
    "paragraph_counts": f"{_PROMPTS} select prompt_id, len(list_filter(regexp_split_to_array(trim(text), '\\n\\s*\\n'), lambda x: trim(x) <> ''))::bigint as n_paragraphs from p",
    "instruction_scores": f"""{_PROMPTS} select prompt_id, round(least(1.0::double, least(len(regexp_extract_all(text, '{_any(P.INSTRUCTION)}')) * 0.4::double, 0.9::double)
  + case when regexp_matches(text, '{_CODE}') then 0.4::double else 0.0::double end), 6) as instruction_score from p""",
    "must_keep": f"{_PROMPTS} select prompt_id, regexp_matches(text, '{_CODE}') or regexp_matches(text, '{_any(P.CRITICAL)}') or regexp_matches(text, '(?i)customer c-1\\d*5 ') as must_keep from p",
    "sentence_priority": f"""{_PROMPTS} select prompt_id, (case when regexp_matches(text, '{_any(P.SAFETY)}') then 4 when regexp_matches(text, '{_any(P.HIGH)}') then 3
  when regexp_matches(text, '{_any(P.MEDIUM)}') or regexp_matches(text, '{_entity_any}') then 2 else 1 end)::bigint as tier from p""",
    "word_similarity": f"""{_PROMPTS},
s as (select prompt_id, {_set.format('text')} as x, {_set.format('other')} as y from (select *, {REWORDING} as other from p)),
n as (select prompt_id, len(x) as nx, len(y) as ny, len(list_intersect(x, y)) as k from s)
select prompt_id, round(coalesce(k / nullif(nx + ny - k, 0), 0)::double, 6) as jaccard, round(coalesce(2 * k / nullif(nx + ny, 0), 0)::double, 6) as rouge1,
  round(coalesce(k / nullif(nx, 0), 0)::double, 6) as overlap from n""",
    "mode_table": "select * from (values " + ", ".join(f"('{m.name}', {m.target_ratio}::double, {len(m.weights)}::bigint, {str(m.preserve_structure).lower()})" for m in MODES.values()) + ") as m(mode, target_ratio, n_weights, preserve_structure)",
    "optimize_json": "select event_id, json(props)::varchar as dense from events",
    "bleu4": f"""{_PROMPTS},
w as (select prompt_id, regexp_extract_all(lower(text), '\\w+') as a, regexp_extract_all(lower({REWORDING}), '\\w+') as b from p),
g as (select prompt_id, n, 'a' as side, unnest(list_transform(range(1, len(a) - n + 2), lambda i: array_to_string(a[i:i + n - 1], ' '))) as gram from w, range(1, 5) as r(n)
  union all select prompt_id, n, 'b', unnest(list_transform(range(1, len(b) - n + 2), lambda i: array_to_string(b[i:i + n - 1], ' '))) from w, range(1, 5) as r(n)),
c as (select prompt_id, n, gram, count(*) filter (where side = 'a') as x, count(*) filter (where side = 'b') as y from g group by all),
q as (select prompt_id, n, (sum(least(x, y)) + 0.1::double) / (sum(y) + 0.1::double) as share from c group by all),
m as (select prompt_id, exp(sum(ln(share)) / 4) as mean from q group by prompt_id)
select prompt_id, round(round(mean * case when len(b) > len(a) then 1 else exp(1 - len(a) / len(b)) end, 4), 3) as bleu4 from m join w using (prompt_id)""",
    "structure_depth": f"""{_TEXTS},
j as (select id, max(s - least(low, 0)) as d from (select id, s, min(s) over (partition by id order by k) as low from (select id, k, sum(v) over (partition by id order by k) as s from (
  select id, unnest(range(len(m))) as k, unnest(list_transform(m, lambda c: case when c in ('{{', '[') then 1 else -1 end)) as v from (select id, regexp_extract_all(text, '[{{}}\\[\\]]') as m from t)))) group by id),
x as (select id, max(s - least(low, 0)) as d from (select id, s, min(s) over (partition by id order by k) as low from (select id, k, sum(v) over (partition by id order by k) as s from (
  select id, unnest(range(len(m))) as k, unnest(list_transform(m, lambda c: case when c = '' then 1 else -1 end)) as v from (select id, regexp_extract_all(text, '<(/?)[a-zA-Z]', 1) as m from t)))) group by id)
select t.id, coalesce(greatest(j.d, 0), 0)::bigint as json_depth, coalesce(greatest(x.d, 0), 0)::bigint as xml_depth,
  (coalesce(list_max(list_transform(list_filter(string_split(text, chr(10)), lambda l: trim(l) <> '' and not starts_with(ltrim(l), '#')), lambda l: length(l) - length(ltrim(l)))), 0) // 2)::bigint as yaml_depth,
  coalesce(list_max(list_transform(regexp_extract_all(text, '(?m)^(#{{1,6}})\\s+\\S', 1), lambda h: length(h))), 0)::bigint as heading_depth
from t left join j using (id) left join x using (id)""",
    "knapsack": """with recursive l as (select l_orderkey, row_number() over (partition by l_orderkey order by l_linenumber, l_quantity, l_extendedprice) as i, l_quantity::int as w, l_extendedprice as v from lineitem),
g as (select l_orderkey, greatest(1, round_even(sum(w) * 0.5::double, 0))::int as goal from l group by 1),
s as (select l_orderkey, 0::bigint as i, 0::bigint as w, 0::double as v from g
  union all select s.l_orderkey, l.i, s.w + k.take * l.w, s.v + k.take * l.v from s join l on l.l_orderkey = s.l_orderkey and l.i = s.i + 1 join g on g.l_orderkey = s.l_orderkey, (values (0), (1)) as k(take)
  where s.w + k.take * l.w <= goal),
b as (select l_orderkey, max(v) as v from s group by 1)
select g.l_orderkey, round(case when b.v > 0 then b.v else (select max(v) from l where l.l_orderkey = g.l_orderkey) end, 2) as value from g join b using (l_orderkey)""",
    "content_types": _content_sql(),
    "line_densities": _densities_sql(),
    "validate_rewrite": _validate_sql(),
}
