"""The registered queries of the corpus operators, with production parameters, and their SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, bpe, langid, lattice, licenses, linededup, packing, simhash, urlrules, warc

TOKENIZER = "byte_bpe_50k.json"


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PPM language of every document, learned from those whose id's CRC-32 leaves a remainder other than 2."""
    part = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(4))
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text", "lang", F.coalesce(part == 2, F.lit(False)).alias("held_out"))
    model = langid.train(docs.where(part != 2))
    return langid.identify(docs, model, keep=("doc_id", "held_out"))


def op2_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest by inner product of every vector whose id is divisible by 20."""
    return ann.search(_read(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, 20)


def op3_lattice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and components of equally labelled vectors with a cosine of 0.93 at least."""
    return lattice.near_dups(_read(spark, sf_dir, "embeddings"), 0.93)


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents packed into sequences of 2048 tokens."""
    packed = packing.pack(_read(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER))
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License notices and texts in documents, with coverage and spans."""
    return licenses.scan(_read(spark, sf_dir, "documents"))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose 3-word SimHash fingerprints differ in 2 bits at most."""
    return simhash.near_dups(_read(spark, sf_dir, "documents"))


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages written to dictionary-compressed archives and read back."""
    return warc.archive(_read(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op8_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict on every page's URL."""
    return urlrules.judge(_read(spark, sf_dir, "pages"))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents without the boilerplate lines of their source."""
    return linededup.dedup_lines(_read(spark, sf_dir, "documents")).select("doc_id", "text", "lines_kept", "lines_dropped")


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of every document's BPE ids and of the text decoded from them."""
    path = public_tokenizers.path(TOKENIZER)
    coded = bpe.round_trip(_read(spark, sf_dir, "documents").select("doc_id", "text"), path)
    return coded.select(
        "doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


_QUERIES = (op1_language_id, op2_nearest, op3_lattice, op4_packing, op5_license_scan, op6_simhash, op7_warc, op8_url_rules, op9_line_dedup, op10_bpe)
QUERIES = {f.__name__: f for f in _QUERIES}

ORACLE_SQL = {
    "op3_lattice": """
        with recursive v as (select vec_id, label, embedding::double[] as e from embeddings where label is not null and list_inner_product(embedding::double[], embedding::double[]) > 0),
        l as (select a.vec_id as x, b.vec_id as y from v a join v b on a.label = b.label and a.vec_id <> b.vec_id where list_cosine_similarity(a.e, b.e) >= 0.93),
        r(x, y) as (select x, y from l union select r.x, l.y from r join l on r.y = l.x),
        c as (select x, min(y) as y from r group by x), n as (select x, count(*) as n from l group by x)
        select e.vec_id, coalesce(n.n, 0)::bigint as n_links, least(e.vec_id, coalesce(c.y, e.vec_id)) as component_id, e.vec_id = least(e.vec_id, coalesce(c.y, e.vec_id)) as kept
        from embeddings e left join n on n.x = e.vec_id left join c on c.x = e.vec_id""",
    "op7_warc": """
        with p as (select page_id, encode(coalesce(html, '')) as payload from pages),
        k as (select payload, max(page_id) as keeper from p where octet_length(payload) >= 1000 group by payload)
        select p.page_id, octet_length(p.payload)::bigint as payload_bytes, sha1(p.payload) as payload_digest,
               case when k.keeper <> p.page_id then 'revisit' else 'response' end as record_type,
               case when k.keeper <> p.page_id then k.keeper end as refers_to
        from p left join k on p.payload = k.payload""",
    "op9_line_dedup": """
        with l as (select doc_id, source, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) as pos from documents),
        t as (select source, count(*) as total from documents group by source),
        b as (select l.source, l.line from (select distinct doc_id, source, line from l where trim(line, ' ') <> '') l join t on l.source = t.source
              group by l.source, l.line, t.total having count(*) >= 5 and count(*) > 0.08 * t.total),
        m as (select l.doc_id, l.line, l.pos, b.line is not null as gone from l left join b on l.source = b.source and l.line = b.line)
        select d.doc_id, case when d.text is not null then coalesce(string_agg(m.line, chr(10) order by m.pos) filter (where not m.gone), '') end as text,
               count(m.pos) filter (where not m.gone) as lines_kept, count(m.pos) filter (where m.gone) as lines_dropped
        from documents d left join m on d.doc_id = m.doc_id group by d.doc_id, d.text""",
}
