"""Registered queries of this subpackage: name -> (spark, sf_dir) -> DataFrame."""

from __future__ import annotations

import uuid

from hydroseries.llm import ann, chat, cnn, decon, html, neardup, passages, repair, secrets, toxic, variants, warc
from hydroseries.llm.common import read_table, remove_at_end
from hydroseries.llm.mix import mix
from hydroseries.session import scratch_path

def op1_mix(spark, sf_dir):
    """All documents, sources weighed 5, 2, 1, repeating, 150 % of all sizes, at most 2 copies."""
    return (mix(read_table(spark, sf_dir, "documents"))
            .select("doc_id", "size", "source_size", "target", "taken", "source", "rate", "copies"))


def op2_html(spark, sf_dir):
    """Main text of every page."""
    return html.extract(read_table(spark, sf_dir, "pages"))


def op3_secrets(spark, sf_dir):
    """Base and model spans of every document."""
    docs = read_table(spark, sf_dir, "documents")
    return secrets.digest(secrets.scan(docs.select("doc_id", "text"), secrets.train(docs)))


def op4_ann(spark, sf_dir):
    """The 5 nearest of every query row among all embeddings."""
    return ann.search_all(read_table(spark, sf_dir, "embeddings"))


def op5_quality(spark, sf_dir):
    """Probability of quality 1 of every document."""
    docs = read_table(spark, sf_dir, "documents")
    model = cnn.fit(docs, read_table(spark, sf_dir, "labels"))
    return cnn.classify(docs.select("doc_id", "text"), model).select("doc_id", "held_out", "score", "predicted")


def op6_neardup(spark, sf_dir):
    """Near-duplicate class of every document (five words, 0.8)."""
    return (neardup.classes(read_table(spark, sf_dir, "documents"))
            .select("doc_id", "class_id", "class_size", "copies"))


def op7_passages(spark, sf_dir):
    """Documents with passages of 50 or more words that repeat in other documents."""
    return passages.repeated(read_table(spark, sf_dir, "documents"))


def op8_toxicity(spark, sf_dir):
    """Probability of toxic 1 of every document."""
    docs = read_table(spark, sf_dir, "documents")
    grammar = toxic.fit(docs, read_table(spark, sf_dir, "labels"))
    return toxic.classify(docs.select("doc_id", "text"), grammar).select("doc_id", "held_out", "score", "predicted")


def op9_decontamination(spark, sf_dir):
    """Passages of benchmark items in documents: doc_id, item_id, similarity, first word, word after the last."""
    return decon.matches(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def op10_warc(spark, sf_dir):
    """Archives of all pages, read back record by record."""
    folder = scratch_path(spark, f"warc-{uuid.uuid4().hex}")
    back = warc.round_trip(read_table(spark, sf_dir, "pages"), folder)
    remove_at_end(spark, folder)
    return back.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op11_chat(spark, sf_dir):
    """Digests of every conversation, read back from its formatted text."""
    return chat.digest(chat.format_turns(chat.with_injected(read_table(spark, sf_dir, "conversations"))))


def op12_variants(spark, sf_dir):
    """Spelling variants among the words of all documents."""
    return variants.group_variants(read_table(spark, sf_dir, "documents"))


def op13_repair(spark, sf_dir):
    """Faults and least repair of every conversation after the damage."""
    return repair.repair_damaged(read_table(spark, sf_dir, "conversations"))


QUERIES = {"op1_mix": op1_mix, "op2_html": op2_html, "op3_secrets": op3_secrets, "op4_ann": op4_ann, "op5_quality": op5_quality,
           "op6_neardup": op6_neardup, "op7_passages": op7_passages, "op8_toxicity": op8_toxicity, "op9_decontamination": op9_decontamination,
           "op10_warc": op10_warc, "op11_chat": op11_chat, "op12_variants": op12_variants, "op13_repair": op13_repair}
ORACLE: dict[str, str] = {
    "op11_chat": chat.ORACLE, "op12_variants": variants.ORACLE, "op13_repair": repair.ORACLE,
    "op10_warc": """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
q AS (SELECT page_id, octet_length(encode(h)) AS payload_bytes, sha1(h) AS payload_digest FROM p),
r AS (SELECT *, CASE WHEN payload_bytes >= 1000 THEN max(page_id) OVER (PARTITION BY payload_digest) END AS best FROM q)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN best IS NOT NULL AND page_id IS DISTINCT FROM best THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id IS DISTINCT FROM best THEN best END AS refers_to
FROM r
""",
}
