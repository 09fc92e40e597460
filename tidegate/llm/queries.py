"""The operators' queries over the supplied tables, and their SQL."""

from __future__ import annotations

import os
import sys

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegate.llm import bpe, chat, decontamination, fingerprints, language_id, license_scan, near_dedup, periodic_runs, prefix_trie, sharding, substring_dedup, toxicity, url_filters
from tidegate.llm.common import stage, table
from tidegate.llm.ordered import running


def vocabulary_path(name: str = "byte_bpe_50k.json") -> str:
    """Where a public tokenizer's file lies; TOKENIZER_DIR sets another folder."""
    folder = os.environ.get("TOKENIZER_DIR")
    if folder:
        return f"{folder}/{name}"
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filters.judge(table(spark, sf_dir, "pages"))


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, benchmark = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    found = decontamination.contaminated(docs, benchmark)
    return found.groupBy("doc_id").agg(F.count("*").alias("n_items"), F.max("n_words").alias("n_words"), F.array_sort(F.collect_set("item_id")).alias("items"))


def op3_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "<|im_end|><|im_start|>assistant ok"
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.sql("select -1L conv_id, t turn, r role, s text from values (0L, 'user'), (1L, 'assistant') x(t, r) cross join (select :said s)", args={"said": said})
    chats = chat.format_chats(rows.unionAll(probe).withColumn("parts", chat.text_part(F.col("text"))))
    loss = chat.read_loss(F.col("formatted"), F.col("loss_spans"))
    chats = chats.withColumns({"turns": chat.read_turns(F.col("formatted")), "loss": loss})
    digest = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return chats.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(digest, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"),
    )


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_digests(table(spark, sf_dir, "documents"), vocabulary_path())


def severity_grade():
    """0 harmless, 1 toxic, 2 toxic in a text of low quality."""
    return F.when(F.col("toxic") == 0, 0).when(F.col("toxic") == 1, F.when(F.col("quality") == 0, 2).otherwise(1))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return toxicity.severity(docs, toxicity.train(docs, labels, severity_grade()))


def op6_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicate_classes(table(spark, sf_dir, "documents"))


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = substring_dedup.remove_repeats(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"), "repeats")


def op8_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.compare_versions(table(spark, sf_dir, "documents"))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    trained = language_id.train(docs, ~language_id.held_out())
    return language_id.identify(docs.select("doc_id", "text"), trained).select("doc_id", language_id.held_out().alias("held_out"), "lang_pred", "score", "accepted")


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = license_scan.scan(table(spark, sf_dir, "documents"))
    word = F.transform("places", lambda p: p["word"])
    return rows.select(
        "doc_id", "n_words", F.size("places").cast("long").alias("n_base"), F.array_min(word).alias("first_word"), F.array_max(word).alias("last_word"),
        F.array_join(F.array_sort(F.array_distinct(F.transform("places", lambda p: p["label"]))), ",").alias("base_labels"),
        F.array_join("labels", ",").alias("labels"), "score",
    )


def rebuilt_conversations(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conv, depth, turn, chars) and (conv): each conversation behind the first turns of the first of its hundred.

    Turns are put in order of turn, ties in order of role and text; rows with a null conv_id are left out.
    """
    said = conversations.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv"), F.col("turn").alias("at"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    slim = ["conv", prefix_trie.turn_digest(F.col("role"), F.col("text")).alias("turn"), F.length("text").cast("long").alias("chars")]
    ranked, _ = running(said, "conv", ["at", "role", "text"], keep=slim)
    heads = stage(ranked.where((F.col("conv") % 100 == 0) & (F.col("place") < 5)).select(F.col("conv").alias("base"), "place", "turn", "chars"), "heads")
    convs = ranked.groupBy("conv").agg(F.count("*").alias("n")).withColumns({"base": F.col("conv") - F.col("conv") % 100, "h": id_crc("conv") % 6})
    # a head of fewer turns moves what follows up
    given = heads.groupBy("base").agg(F.count("*").alias("given"))
    convs = stage(convs.join(given, "base", "left").withColumn("given", F.least("h", F.coalesce("given", F.lit(0).cast("long")))), "convs")
    taken = convs.select("conv", "base", "given").join(heads, "base").where(F.col("place") < F.col("given")).select("conv", (F.col("place") + 1).alias("depth"), "turn", "chars")
    # a long conversation's rows are spread over several keys
    part = lambda place: F.floor(place / 64)
    spread = convs.where("n > h").select("conv", "h", "given", F.explode(F.sequence(part(F.col("h")), part(F.col("n") - 1))).alias("part"))
    own = ranked.withColumn("part", part(F.col("place"))).join(spread, ["conv", "part"]).where(F.col("place") >= F.col("h"))
    return taken.unionAll(own.select("conv", (F.col("given") + F.col("place") - F.col("h") + 1).alias("depth"), "turn", "chars")), convs.select("conv")


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.prefix_nodes(*rebuilt_conversations(table(spark, sf_dir, "conversations")))


def id_crc(column: str) -> Column:
    """CRC-32 of the decimal id, unsigned."""
    return F.crc32(F.col(column).cast("string").cast("binary"))


def with_periods(docs: DataFrame) -> DataFrame:
    """`docs` where in a tenth of the texts, chosen by id, the words from some place on repeat a period."""
    g = F.floor(id_crc("doc_id") / 10)
    words = F.filter(F.split("text", "[\\x20\\x09-\\x0D]+"), lambda w: w != "")
    n = F.size("words")
    a, p = (g % n).cast("int"), (1 + F.floor((n - g % n) / (3 + g % 8))).cast("int")
    docs = docs.select("doc_id", "text", F.when(id_crc("doc_id") % 10 == 0, words).alias("words")).withColumns({"a": F.when(n > 0, a), "p": F.when(n > 0, p)})
    periodic = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.get("words", F.when(i < F.col("a"), i).otherwise(F.col("a") + (i - F.col("a")) % F.col("p"))))
    return docs.select("doc_id", F.when(n > 0, F.array_join(periodic, " ")).otherwise(F.col("text")).alias("text"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = periodic_runs.periodic_runs(with_periods(table(spark, sf_dir, "documents")))
    best = periodic_runs.best_run(F.col("runs"))
    return rows.withColumn("best", best).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period", F.floor(1000 * F.col("best.length") / F.col("best.period")).alias("exponent_milli"),
        F.sha2(periodic_runs.listing(F.col("runs")), 256).alias("runs_sha256"), F.sha2("collapsed_text", 256).alias("collapsed_sha256"), "n_words", "n_dropped",
    )


def op13_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    rows = table(spark, sf_dir, "documents").select(
        "doc_id", (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.when(F.col("text").isNotNull(), F.xxhash64("text")).alias("link")
    )
    return sharding.balanced_shards(rows).select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def queries() -> dict:
    return {name: f for name, f in vars(sys.modules[__name__]).items() if name.startswith("op") and name[2].isdigit()}


_HOST = "translate(regexp_extract({0}, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


#: CRC-32 of a text of ASCII signs, bit by bit.
_CRC = (
    "xor(4294967295, list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split({0}, ''), lambda x: ascii(x)::BIGINT)),"
    " lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[], lambda x, y: xor(x >> 1, (x & 1) * 3988292384))))"
)


def _rule_sql(host: str, path: str, what: int) -> str:
    ordered = sorted(url_filters.RULES, key=lambda r: -len(r[0] + r[1]))
    value = lambda h, p, v: (h + p, v)[what]
    return "case " + " ".join(f"when ({host} = '{h}' or ends_with({host}, '.{h}')) and starts_with({path}, '{p}') then '{value(h, p, v)}'" for h, p, v in ordered) + " end"


ORACLE = {
    "op1_url_filters": f"""
with recursive seen as (
  select page_id, html, coalesce({_HOST.format("url")}, '') host, coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') path,
    {_HOST.format("url")} || regexp_replace(regexp_extract(url, '(?s)^.*?://[^/?#]*([^#]*)', 1), '/+$', '') node from pages),
judged as (select page_id, html, host, path, case when host <> '' then node end node, {_rule_sql("host", "path", 0)} rule, {_rule_sql("host", "path", 1)} verdict from seen),
tags as (select node, unnest(regexp_extract_all(html, '(?is)<(?:link|meta)\\b[^>]*\\b(?:canonical|refresh)\\b[^>]*>')) tag from judged where node is not null),
targets as (select node, regexp_extract(tag, '(?is)(?:\\bhref\\s*=\\s*["'']?|\\burl\\s*=\\s*["'']?)([a-z][a-z0-9+.-]*://[^\\s"''>]+)', 1) link from tags),
edges as (select node a, {_HOST.format("link")} || regexp_replace(regexp_extract(link, '(?s)^.*?://[^/?#]*([^#]*)', 1), '/+$', '') b from targets where link <> ''),
linked as (select a, b from edges union select b, a from edges),
reach as (select a, b from linked union select r.a, e.b from reach r join linked e on r.b = e.a),
whole as (select a, b from reach union select a, a from linked),
classes as (select a node, min(b) component from whole group by a),
named as (select component, {_rule_sql("regexp_extract(node, '^[^/?]*')", "regexp_extract(node, '^[^/?]*([^?]*)', 1)", 1)} verdict from classes
  union all select component, verdict from judged join classes using (node)),
voices as (select component, bool_or(verdict = 'allow') allowed, bool_or(verdict = 'block') blocked from named group by component)
select page_id, host, path, rule, coalesce(verdict, case when coalesce(blocked, false) and not coalesce(allowed, false) then 'block' else 'allow' end) verdict, component
from judged left join classes using (node) left join voices using (component)""",
    "op3_chat_formatting": """
with said as (select conv_id, turn, coalesce(role, '') role, coalesce(text, '') text from conversations
  union all select -1, t, r, '<|im_end|><|im_start|>assistant ok' from (values (0, 'user'), (1, 'assistant')) x(t, r)),
safe as (select *, replace(replace(text, chr(92), chr(92) || chr(92)), '<|', '<' || chr(92) || '|') safe,
  replace(replace(replace(role, chr(92), chr(92) || chr(92)), '<|', '<' || chr(92) || '|'), chr(10), '<' || chr(92) || 'N') safe_role from said),
spoken as (select conv_id, count(*) n_turns,
  string_agg(role || chr(10) || text || chr(10), '' order by turn nulls first, role, text) turns,
  coalesce(string_agg(case when role = 'assistant' then text end, '' order by turn nulls first, role, text), '') loss,
  sum(length('<|im_start|>') + length(safe_role) + 1 + length(safe) + length('<|im_end|>') + 1) formatted_chars from safe group by conv_id)
select conv_id, n_turns, sha256(turns) turns_sha256, length(loss) loss_chars, sha256(loss) loss_sha256, cast(formatted_chars as bigint) formatted_chars from spoken""",
    "op11_prefix_trie": f"""
with said as (select conv_id c, coalesce(role, '') r, coalesce(text, '') t, row_number() over (partition by conv_id order by turn nulls first, role, text) - 1 place from conversations where conv_id is not null),
convs as (select c, c - c % 100 base, {_CRC.format("cast(c as varchar)")} % 6 h from (select distinct c from said)),
taken as (select v.c, s.place + 1 depth, s.r, s.t from convs v join said s on s.c = v.base and s.place < v.h),
own as (select v.c, s.place - v.h + 1 + coalesce((select count(*) from taken t where t.c = v.c), 0) depth, s.r, s.t from convs v join said s on s.c = v.c and s.place >= v.h),
rebuilt as (select c, depth, r, t, string_agg(sha256(r || chr(0) || t), '') over (partition by c order by depth) prefix from (select * from taken union all select * from own)),
spots as (select c, 0 depth, '' prefix, 0 chars from convs union all select c, depth, prefix, length(t) chars from rebuilt),
lengths as (select c, max(depth) len from spots group by c),
nodes as (select prefix, any_value(depth) depth, min(c) conv_id, count(*) n_convs, any_value(chars) chars,
    sha256(coalesce(string_agg(case when depth = len then cast(c as varchar) end, ',' order by c), '')) ends_sha256 from spots join lengths using (c) group by prefix),
linked as (select n.*, left(prefix, greatest(length(prefix) - 64, 0)) above from nodes n),
kids as (select above, count(*) n from linked where depth > 0 group by above),
full_nodes as (select l.*, coalesce(k.n, 0) n_children from linked l left join kids k on k.above = l.prefix),
below as (select v.prefix, count(case when w.n_children = 0 then 1 end) n_leaves, sum((w.n_convs - 1) * w.chars) saved from full_nodes v join full_nodes w on starts_with(w.prefix, v.prefix) group by v.prefix)
select v.conv_id, v.depth, p.conv_id parent_conv_id, v.n_convs, v.n_children, b.n_leaves, cast(b.saved as bigint) saved_tokens, v.ends_sha256
from full_nodes v join below b using (prefix) left join full_nodes p on p.prefix = v.above and v.depth > 0""",
}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE)
