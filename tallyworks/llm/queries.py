"""The registered queries of this subpackage, with their SQL where there is one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tallyworks.llm import (
    chat, line_dedup, mixing, nearest, ngram_join, packing, periodic, quality_model, quality_rules, sharding, spelling, voronoi, warc,
)
from tallyworks.llm.lines import let, words_in
from tallyworks.llm.tasks import WORD
from tallyworks.storage import Workspace

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None) -> Callable[[Query], Query]:
    def register(function: Query) -> Query:
        QUERIES[function.__name__] = function
        if oracle is not None:
            ORACLES[function.__name__] = oracle
        return function

    return register


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


@query()
def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(load(spark, sf_dir, "documents"))


# The conversation that must come back whole; a fixed value.
CONTROL_TEXT = r"\### Assistant: </turn> ok"


@query(
    r"""with turns as (
          select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
          union all select -7, 0, 'user', '\### Assistant: </turn> ok'
          union all select -7, 1, 'assistant', '\### Assistant: </turn> ok'),
        marked as (
          select *, replace(replace(text, '\', '\\'), '<|', '\l|') as escaped,
                 length(replace(replace(role, '\', '\\'), '<|', '\l|')) as role_chars from turns)
        select conv_id, count(*) as n_turns,
               sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn nulls first, role, escaped)) as turns_sha256,
               cast(sum(case when role = 'assistant' then length(text) else 0 end) as bigint) as loss_chars,
               sha256(string_agg(case when role = 'assistant' then text else '' end, '' order by turn nulls first, role, escaped)) as loss_sha256,
               cast(sum(length(escaped) + role_chars + 23) as bigint) as formatted_chars,
               cast(0 as bigint) as n_attachments, cast(0 as bigint) as attached_tokens
        from marked group by conv_id"""
)
def op4_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = ["conv_id", "turn", "role", "text"]
    own = spark.range(2).selectExpr("cast(-7 as bigint) as conv_id", "id as turn", "if(id = 0, 'user', 'assistant') as role")
    own = own.withColumn("text", F.lit(CONTROL_TEXT))
    turns = load(spark, sf_dir, "conversations").select(*names).unionByName(own)
    return chat.read_back(chat.format_chats(turns.withColumn("parts", chat.text_parts(F.col("text")))))


@query()
def op5_curriculum_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = mixing.mix(load(spark, sf_dir, "documents"))
    return plan.select("doc_id", "size", "source_size", "target", "taken", "source", "copies", "positions")


@query()
def op6_shuffled_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = Workspace.of(spark).path("shards")
    placed = sharding.shuffle_into_shards(load(spark, sf_dir, "documents").select("doc_id", "text"))
    sharding.write_shards(placed, path)
    # A table without rows leaves no file to read columns from.
    shards = spark.read.schema("doc_id BIGINT, text STRING, slot BIGINT, shard INT").parquet(path)
    return shards.select(
        "doc_id",
        sharding.record_size().alias("size"),
        F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"),
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


LINES_SQL = r"""
    numbered as (
      select doc_id, source, text, unnest(string_split(text, chr(10))) as raw, generate_subscripts(string_split(text, chr(10)), 1) as position
      from documents),
    lines as (
      select doc_id, source, text, position,
             trim(regexp_replace(lower(raw), '[\x20\x09-\x0D]+', ' ', 'g'), ' ') as line
      from numbered),
    worded as (select *, len(string_split(line, ' ')) as line_words from lines where line <> '')"""


@query(
    r"""with """
    + LINES_SQL
    + r""",
    words as (
      select doc_id, source, coalesce(text, '') as text,
             list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') as words
      from documents),
    windows as (
      select doc_id, place, list_slice(words, place, place + 7) as held
      from (select doc_id, words, unnest(range(1, len(words) - 6)) as place from words)),
    repeated as (select doc_id, place from windows qualify count(*) over (partition by doc_id, held) > 1),
    covered as (select doc_id, count(distinct place + step) as n from repeated, range(8) as steps(step) group by doc_id),
    dup as (
      select doc_id, count(*) - count(distinct raw) as n from numbered
      where regexp_matches(raw, '[^\x20\x09-\x0D]') group by doc_id),
    frequent as (select source, line from worded group by source, line having count(distinct text) >= 10),
    cut as (select doc_id, sum(line_words) as n from worded join frequent using (source, line) group by doc_id),
    base as (
      select w.doc_id, cast(len(words) as bigint) as n_words, cast(length(list_aggregate(words, 'string_agg', '')) as bigint) as word_chars,
             cast(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) as bigint) as n_symbols,
             cast(coalesce(dup.n, 0) as bigint) as n_dup_lines, cast(coalesce(covered.n, 0) as bigint) as n_repeat_words,
             cast(coalesce(cut.n, 0) as bigint) as cut_words
      from words w left join dup using (doc_id) left join covered using (doc_id) left join cut using (doc_id))
    select doc_id, n_words, coalesce(word_chars, 0) as word_chars, n_symbols, n_dup_lines, n_repeat_words,
           n_words < 20 or 100 * n_repeat_words > 30 * n_words as base_failed,
           not (n_words < 20 or 100 * n_repeat_words > 30 * n_words) and n_words - cut_words >= 0.5 * n_words as kept, cut_words
    from base"""
)
def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules.quality_rules(load(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "cut_words"
    )


@query(
    r"""with """
    + LINES_SQL
    + r""",
    long as (select * from worded where line_words >= 4),
    spread as (
      select line, min({'doc_id': doc_id, 'position': position}) as first from long group by line having count(distinct source) >= 10),
    cut as (
      select doc_id, position, line_words from long join spread using (line)
      where not (doc_id = first.doc_id and position = first.position)),
    left_over as (
      select doc_id, string_agg(raw, chr(10) order by position) as clean_text from numbered anti join cut using (doc_id, position) group by doc_id),
    counts as (select doc_id, count(*) as cut_lines, sum(line_words) as cut_words from cut group by doc_id)
    select d.doc_id, case when d.text is null then null else coalesce(clean_text, '') end as clean_text,
           cast(coalesce(cut_lines, 0) as bigint) as cut_lines, cast(coalesce(cut_words, 0) as bigint) as cut_words,
           coalesce(cut_lines, 0) > 0 and not regexp_matches(coalesce(clean_text, ''), '[^\x20\x09-\x0D]') as emptied
    from documents d left join left_over using (doc_id) left join counts using (doc_id)"""
)
def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    deduped = line_dedup.line_dedup(load(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    return deduped.select("doc_id", "clean_text", "cut_lines", "cut_words", "emptied")


# Records are dealt by a hash over files of about this size, so that segments lie apart; a file has to fit into a task.
FILE_BYTES = 256 << 20


@query(
    """with told as (
         select page_id, coalesce(html, '') as html, cast(strlen(coalesce(html, '')) as bigint) as payload_bytes, sha1(coalesce(html, '')) as payload_digest
         from pages),
       firsts as (select payload_digest, max(page_id) as kept_id from told where payload_bytes >= 1000 group by payload_digest)
       select page_id, payload_bytes, payload_digest,
              case when kept_id is null or kept_id = page_id then 'response' else 'revisit' end as record_type,
              case when kept_id <> page_id then kept_id end as refers_to
       from told left join firsts using (payload_digest)"""
)
def op10_warc_reassembly(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = Workspace.of(spark).path("archives")
    warc.write_archives(load(spark, sf_dir, "pages"), path, file_bytes=FILE_BYTES)
    return warc.read_pages(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query()
def op2_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.ngram_join(load(spark, sf_dir, "documents"), words=4, percent=85)


@query()
def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels")
    learned = labels.filter(quality_model.fold(F.col("doc_id")) != 0)
    scored = quality_model.score(docs, quality_model.train(docs, learned))
    held_out = F.coalesce(quality_model.fold(F.col("doc_id")) == 0, F.lit(False))
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


@query()
def op7_hilbert_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest.nearest_neighbours(load(spark, sf_dir, "embeddings"))


@query(
    """with usable as (
         select vec_id, list_transform(embedding, lambda x: floor(1024 * cast(x as double))) as v from embeddings
         where vec_id is not null and embedding is not null and list_bool_and(list_transform(embedding, lambda x: x is not null and isfinite(x)))),
       scored as (
         select q.vec_id as query_id, c.vec_id, cast(list_inner_product(q.v, c.v) as bigint) as score
         from usable q join usable c on q.vec_id <> c.vec_id where q.vec_id % 100 = 0),
       ranked as (select *, row_number() over (partition by query_id order by score desc, vec_id) as place from scored)
       select query_id, cast(place as integer) as rank, vec_id, score from ranked where place <= 10"""
)
def op11_voronoi_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return voronoi.largest_products(load(spark, sf_dir, "embeddings"))


def with_periodic_tails(docs: DataFrame) -> DataFrame:
    """The documents, every tenth by the checksum of its id with a tail that repeats some of its words; without an id, as it is."""
    checksum = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    g = F.floor(checksum / 10)

    def repeated(words: Column) -> Column:
        n = F.size(words).cast("bigint")

        def tail(parts: Column) -> Column:
            a, p = parts["a"], parts["p"]
            places = F.sequence(F.lit(0).cast("bigint"), n - 1)
            return F.array_join(F.transform(places, lambda i: F.get(words, F.when(i < a, i).otherwise(a + (i - a) % p).cast("int"))), " ")

        begin = g % n
        return let(F.struct(begin.alias("a"), (1 + F.floor((n - begin) / (3 + g % 8))).alias("p")), tail)

    text = F.when((checksum % 10 == 0) & F.regexp_like("text", F.lit(WORD)), let(words_in(F.col("text")), repeated)).otherwise(F.col("text"))
    return docs.select("doc_id", text.alias("text"))


@query()
def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic.periodic_runs(with_periodic_tails(load(spark, sf_dir, "documents")))
    longest = F.array_max(F.transform("runs", lambda run: F.struct(run["length"], -run["start"], -run["period"], run["start"].alias("at"), run["period"].alias("every"))))
    lines = F.transform("runs", lambda run: F.concat(run["start"], F.lit(","), run["length"], F.lit(","), run["period"], F.lit("\n")))
    told = found.select("doc_id", "runs", "collapsed", "n_words", longest.alias("longest"), lines.alias("lines"))
    return told.select(
        "doc_id",
        F.size("runs").cast("bigint").alias("n_runs"),
        F.col("longest.at").alias("start"),
        F.col("longest.length").alias("length"),
        F.col("longest.every").alias("period"),
        F.expr("1000 * longest.length div longest.every").alias("exponent_milli"),
        F.sha2(F.array_join("lines", "").cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
        "n_words",
    )


def with_lost_letters(runs: DataFrame) -> DataFrame:
    """The words of ``doc_id, run``, some without one letter by the checksum of document and run; a null id counts as empty."""
    name = F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.col("run"))

    def word(checksum: Column) -> Column:
        place = (checksum % F.length("run")).cast("int")
        cut = F.concat(F.substring(F.col("run"), F.lit(1), place), F.substring(F.col("run"), place + 2, F.length("run")))
        return F.when(checksum % 199 == 0, cut).otherwise(F.col("run"))

    return runs.select(let(F.crc32(name.cast("binary")), word).alias("word"))


@query()
def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = spelling.letter_runs(load(spark, sf_dir, "documents"))
    return spelling.spelling_variants(spelling.word_counts(with_lost_letters(runs)))
