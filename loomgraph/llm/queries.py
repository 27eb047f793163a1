"""The queries of the training-data operators over their whole tables, and their SQL where it has any."""

from __future__ import annotations

from . import byte_bpe, html_text, language_id, licences, motion_jpeg, ngram_join, packing, repeats, token_files, top_k, url_filter, vector_codes, whitening
from .common import table


def op1_licences(spark, sf_dir):
    return licences.scan(table(spark, sf_dir, "documents"))


def op2_html_text(spark, sf_dir):
    return html_text.extract(table(spark, sf_dir, "pages"))


def op3_motion_jpeg(spark, sf_dir):
    return motion_jpeg.features(motion_jpeg.to_media(table(spark, sf_dir, "documents")))


def op4_url_filter(spark, sf_dir):
    return url_filter.judge(table(spark, sf_dir, "pages"))


def op5_repeats(spark, sf_dir):
    return repeats.remove_repeats(table(spark, sf_dir, "documents"))


def op6_top_k(spark, sf_dir):
    return top_k.nearest(table(spark, sf_dir, "embeddings"))


def op7_byte_bpe(spark, sf_dir):
    return byte_bpe.encode_decode(table(spark, sf_dir, "documents"))


def op8_language_id(spark, sf_dir):
    return language_id.identify(table(spark, sf_dir, "documents"))


def op9_ngram_join(spark, sf_dir):
    return ngram_join.join(table(spark, sf_dir, "documents"))


def op10_packing(spark, sf_dir):
    return packing.pack(table(spark, sf_dir, "documents"))


def op11_vector_codes(spark, sf_dir):
    return vector_codes.encode(table(spark, sf_dir, "embeddings"))


def op12_whitening(spark, sf_dir):
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


def op13_token_files(spark, sf_dir):
    return token_files.write_and_read(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_licences, op2_html_text, op3_motion_jpeg, op4_url_filter, op5_repeats, op6_top_k, op7_byte_bpe, op8_language_id, op9_ngram_join, op10_packing, op11_vector_codes, op12_whitening, op13_token_files)}
ORACLES = {"op1_licences": licences.ORACLE, "op4_url_filter": url_filter.ORACLE, "op6_top_k": top_k.ORACLE, "op11_vector_codes": vector_codes.ORACLE}
