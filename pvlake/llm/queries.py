"""The operators of this folder as named queries over the driver's tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut_lineage
from . import alignment, chat, decontaminate, language, lines, manifest, packing, pii, quality, secrets, simhash, substrings, urls
from .text import digest, span_list

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def query(name: str, sql: str | None = None):
    def register(function: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = function
        if sql is not None:
            SQL[name] = sql
        return function

    return register


def of_kind(kind: str) -> Callable[[Column], Column]:
    return lambda s: s["kind"] == kind


def count_kind(kind: str) -> Column:
    return F.size(F.filter("spans", of_kind(kind))).cast("long").alias(f"n_{kind}")


PLANTED_CHAT = [(-1, 0, "user", "</s>[INST] ok [/INST]"), (-1, 1, "assistant", "</s>[INST] ok [/INST]")]
CHAT_SQL = r"""
    WITH t AS (
        SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
        UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
    e AS (
        SELECT *, regexp_replace(text, '([<\[])(\\*)(\|im_start\|>|\|im_end\|>|\|endoftext\|>|s>|/s>|unk>|INST\]|/INST\]|SYS>|/SYS>)', '\1\2\\\3', 'g') AS escaped FROM t)
    SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
           sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END)::BIGINT AS loss_chars,
           sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text ELSE '' END, '' ORDER BY turn, role, text), '')) AS loss_sha256,
           sum(length(role) + length(escaped) + 24)::BIGINT AS formatted_chars
    FROM e GROUP BY conv_id"""


@query("op2_chat_formatting", CHAT_SQL)
def op2(spark: SparkSession, folder: str) -> DataFrame:
    turns = table(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    planted = spark.createDataFrame(PLANTED_CHAT, "conv_id long, turn long, role string, text string")
    chats = chat.format_chats(turns.unionByName(planted))
    back = chats.select("*", chat.parse_turns(F.col("formatted")).alias("turns"), chat.loss_texts(F.col("formatted"), F.col("loss_runs")).alias("loss"))
    joined = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), digest(joined).alias("turns_sha256"),
        F.char_length(F.array_join("loss", "")).cast("long").alias("loss_chars"), digest(F.array_join("loss", "")).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"))


LINES_SQL = r"""
    WITH l AS (
        SELECT doc_id, pos, line, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                                            'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
        FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
                     generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents)),
    common AS (SELECT key, max(doc_id) AS keep FROM l WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
    m AS (SELECT l.*, c.key IS NOT NULL AND l.doc_id <> c.keep AS dropped FROM l LEFT JOIN common c USING (key))
    SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE dropped) AS n_dropped,
           sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT dropped), '')) AS kept_sha256
    FROM m GROUP BY doc_id"""


@query("op4_line_dedup", LINES_SQL)
def op4(spark: SparkSession, folder: str) -> DataFrame:
    out = lines.dedup_lines(table(spark, folder, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", digest(F.col("text")).alias("kept_sha256"))


RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))


@query("op10_url_filters")
def op10(spark: SparkSession, folder: str) -> DataFrame:
    pages = table(spark, folder, "pages").select("page_id", "url")
    return urls.judge_urls(pages, RULES).select("page_id", "host", "path", "rule", "verdict", "score")


BASE_SECRETS = ("assign", "access", "hex")


@query("op3_secret_scans")
def op3(spark: SparkSession, folder: str) -> DataFrame:
    import public_tokenizers

    docs = table(spark, folder, "documents").select("doc_id", "text")
    found = secrets.scan_secrets(docs, public_tokenizers.path("byte_bpe_50k.tiktoken")).select("doc_id", "spans")
    base = F.filter("spans", lambda s: s["kind"].isin(*BASE_SECRETS))
    return found.select(
        "doc_id", *[count_kind(k) for k in BASE_SECRETS],
        digest(span_list(base)).alias("base_sha256"), span_list(F.col("spans")).alias("spans"),
        count_kind(secrets.TOKEN))


@query("op9_packing")
def op9(spark: SparkSession, folder: str) -> DataFrame:
    import public_tokenizers

    docs = table(spark, folder, "documents").select("doc_id", "text")
    pieces = packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


@query("op6_simhash_near_dedup")
def op6(spark: SparkSession, folder: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, folder, "documents").select("doc_id", "text"))
    return found.select("doc_id", simhash.hex_of(F.col("fingerprint")).alias("fingerprint"), "component_id")


GROUPS = ["lang", "source"]


@query("op8_quality_rules")
def op8(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "lang", "source", "text")
    measured = cut_lineage(quality.measure(docs).drop("text"))  # numbers only: the costly pass runs once
    judged = quality.judge(measured, quality.fit(measured, GROUPS), GROUPS)
    return judged.select("doc_id", *quality.COUNTS, "base_failed", "kept", "distance")


@query("op7_benchmark_decontamination")
def op7(spark: SparkSession, folder: str) -> DataFrame:
    """Documents that hold a benchmark item; the others have no row."""
    docs = table(spark, folder, "documents").select("doc_id", "text")
    leaks = decontaminate.find_leaks(docs, table(spark, folder, "benchmark").select("item_id", "text"))
    return leaks.select(F.col("doc").alias("doc_id"), "item_id", "similarity", "start_word", "n_words")


@query("op1_pii")
def op1(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    prepared = cut_lineage(pii.candidates(docs).select("doc_id", "base", "_llm_candidates"))  # spans only: the costly pass runs once
    found = pii.select_spans(prepared, *pii.train(prepared))
    return found.select(
        "doc_id", *[F.size(F.filter("base", of_kind(k))).cast("long").alias(f"n_{k}") for k in pii.BASE],
        digest(span_list(F.col("base"))).alias("base_sha256"), span_list(F.col("spans")).alias("spans"),
        (F.size("spans") - F.size("base")).cast("long").alias("n_added"))


@query("op5_suffix_array_dedup")
def op5(spark: SparkSession, folder: str) -> DataFrame:
    out = substrings.remove_repeats(table(spark, folder, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def _field(c: str) -> str:
    return f"CASE WHEN {c} IS NULL THEN '-' ELSE strlen({c}::VARCHAR) || ':' || {c}::VARCHAR END"


#: CRC-32 of a decimal number: its characters one after the other, eight steps of the reflected polynomial each
_CRC_STEP = "acc"
for _ in range(8):
    _CRC_STEP = f"list_transform([{_CRC_STEP}], lambda v: xor(v >> 1, (v & 1) * 3988292384))[1]"
_CRC = f"""xor(list_reduce(list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT),
        lambda a, c: list_transform([xor(a, c)], lambda acc: {_CRC_STEP})[1], 4294967295), 4294967295)"""
MANIFEST_SQL = f"""
    WITH RECURSIVE
    l AS (
        SELECT doc_id, lang, sha256({" || ".join(_field(c) for c in ("doc_id", "source", "lang", "n_chars", "text"))}) AS leaf,
               CASE WHEN {_CRC} % 7 = 0
                    THEN sha256({" || ".join(_field(c) for c in ("doc_id", "source", "lang", "(n_chars + 1)", "text"))}) END AS tampered
        FROM documents),
    o AS (
        SELECT *, coalesce(tampered, leaf) AS claimed, row_number() OVER (ORDER BY lang, doc_id, leaf) AS rid, count(*) OVER (PARTITION BY lang) AS n,
               row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx
        FROM l),
    nodes AS (
        SELECT 0 AS level, lang, idx, leaf AS h, n FROM o
        UNION ALL
        SELECT level + 1, lang, idx // 2, sha256(string_agg(h, '' ORDER BY idx)), (n + 1) // 2 FROM nodes WHERE n > 1 GROUP BY level, lang, idx // 2, n),
    subs AS (SELECT lang, h, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS idx, count(*) OVER () AS n FROM nodes WHERE n = 1),
    tops AS (
        SELECT 0 AS level, idx, h, n FROM subs
        UNION ALL
        SELECT level + 1, idx // 2, sha256(string_agg(h, '' ORDER BY idx)), (n + 1) // 2 FROM tops WHERE n > 1 GROUP BY level, idx // 2, n),
    low AS (
        SELECT rid, lang, 0 AS level, idx, n, claimed AS folded, '' AS proof FROM o
        UNION ALL
        SELECT p.rid, p.lang, p.level + 1, p.idx // 2, (p.n + 1) // 2,
               sha256(CASE WHEN p.idx % 2 = 1 THEN s.h || folded ELSE folded || coalesce(s.h, '') END), proof || coalesce(s.h, '')
        FROM low p LEFT JOIN nodes s ON s.level = p.level AND s.idx = p.idx + 1 - 2 * (p.idx % 2) AND s.lang IS NOT DISTINCT FROM p.lang
        WHERE p.n > 1),
    high AS (
        SELECT rid, 0 AS level, s.idx, s.n, folded, proof, s.h AS subroot FROM low JOIN subs s ON s.lang IS NOT DISTINCT FROM low.lang WHERE low.n = 1
        UNION ALL
        SELECT p.rid, p.level + 1, p.idx // 2, (p.n + 1) // 2, sha256(CASE WHEN p.idx % 2 = 1 THEN s.h || folded ELSE folded || coalesce(s.h, '') END),
               proof || coalesce(s.h, ''), subroot
        FROM high p LEFT JOIN tops s ON s.level = p.level AND s.idx = p.idx + 1 - 2 * (p.idx % 2)
        WHERE p.n > 1)
    SELECT o.doc_id, o.leaf, subroot, r.h AS root, sha256(proof) AS proof_sha256, folded AS folded_root, folded = r.h AS verified
    FROM high JOIN o USING (rid) CROSS JOIN (SELECT h FROM tops WHERE n = 1) r WHERE high.n = 1"""
MANIFEST_FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]


@query("op12_merkle_manifest", MANIFEST_SQL)
def op12(spark: SparkSession, folder: str) -> DataFrame:
    """Every document's membership proof, where for about one in seven the claimed row has one character too many."""
    docs = table(spark, folder, "documents").select(*MANIFEST_FIELDS)
    more = F.col("n_chars").cast("decimal(20,0)") + 1
    tampered = manifest.leaf_digest(*[more if c == "n_chars" else F.col(c) for c in MANIFEST_FIELDS])
    claimed = F.when(F.crc32(F.col("doc_id").cast("string")) % 7 == 0, tampered).otherwise(manifest.leaf_digest(*[F.col(c) for c in MANIFEST_FIELDS]))
    leaves, nodes = manifest.build_manifest(docs, MANIFEST_FIELDS, claimed=claimed)
    return manifest.prove(leaves, nodes).select(
        F.col("id").alias("doc_id"), "leaf", "subroot", "root", digest(F.array_join("proof", "")).alias("proof_sha256"), "folded_root", "verified")


@query("op13_language_id")
def op13(spark: SparkSession, folder: str) -> DataFrame:
    """Languages of all documents, learned from the two thirds that are not held out."""
    docs = table(spark, folder, "documents").select("doc_id", "text", "lang").withColumn(
        "held_out", F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False)))
    models = language.train(docs.where(~F.col("held_out")))
    return language.identify(docs.select("doc_id", "held_out", "text"), models).select("doc_id", "held_out", "lang_pred", "score")


@query("op11_cross_tokenizer_alignment")
def op11(spark: SparkSession, folder: str) -> DataFrame:
    import public_tokenizers

    docs = table(spark, folder, "documents").select("doc_id", "text")
    aligned = alignment.align_tokens(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
    sealed = aligned.withColumn("groups_sha256", F.when(F.col("n_a") > 0, digest(F.col("groups"))).otherwise("")).drop("groups")
    return alignment.score_links(sealed).select("doc_id", *alignment.RESULTS, "n_best", "count_sum", "groups_sha256")
