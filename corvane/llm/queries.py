"""The registered queries: each operator over its whole table with production parameters, and SQL twins where SQL can say it."""

from __future__ import annotations

from . import common as C
from .oracle import OP8, OP9


def byte_bpe_50k() -> str:
    import public_tokenizers

    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as f:
        return f.read()


def op1_token_counts(spark, sf_dir):
    from pyspark.sql import functions as F

    from .token_counts import count_tokens, sample_edits

    return count_tokens(C.table(spark, sf_dir, "documents"), byte_bpe_50k(), sample_edits(F.col("text")))


def op2_ngram_jaccard_join(spark, sf_dir):
    from .set_join import jaccard_components

    return jaccard_components(C.table(spark, sf_dir, "documents"), k=3, num=90, den=100)


def op3_html_extraction(spark, sf_dir):
    from .html_text import extract

    return extract(C.table(spark, sf_dir, "pages"))


def op4_quality_classifier(spark, sf_dir):
    from .quality import judge

    return judge(C.table(spark, sf_dir, "documents"), C.table(spark, sf_dir, "labels"))


def op5_token_files(spark, sf_dir):
    from .token_files import token_digests

    return token_digests(C.table(spark, sf_dir, "documents"), byte_bpe_50k(), end_id=0)


def op6_decontamination(spark, sf_dir):
    from .decontaminate import contaminated

    return contaminated(C.table(spark, sf_dir, "documents"), C.table(spark, sf_dir, "benchmark"))


def op7_embedding_near_dedup(spark, sf_dir):
    from .vector_join import near_duplicates

    return near_duplicates(C.table(spark, sf_dir, "embeddings"), least=0.95)


def op8_mixing(spark, sf_dir):
    from .mixing import mix_sizes

    return mix_sizes(C.table(spark, sf_dir, "documents"))


def op9_url_filter(spark, sf_dir):
    from .url_filter import judge

    return judge(C.table(spark, sf_dir, "pages"))


def op10_suffix_array_dedup(spark, sf_dir):
    from .long_repeats import remove_repeats

    return remove_repeats(C.table(spark, sf_dir, "documents"), length=400)


QUERIES = {f.__name__: f for f in (op1_token_counts, op2_ngram_jaccard_join, op3_html_extraction, op4_quality_classifier, op5_token_files, op6_decontamination, op7_embedding_near_dedup, op8_mixing, op9_url_filter, op10_suffix_array_dedup)}
ORACLE_SQL = {"op8_mixing": OP8, "op9_url_filter": OP9}
