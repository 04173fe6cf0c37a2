"""The queries of this subpackage and the SQL that gives the same rows."""

from __future__ import annotations

from linkspark.llm.centroids import OP12_SQL, op12_centroid_clusters
from linkspark.llm.chat import OP5_SQL, op5_chat_format
from linkspark.llm.decontaminate import op7_decontaminate
from linkspark.llm.jaccard import OP4_SQL, op4_ngram_jaccard
from linkspark.llm.lattice import op9_lattice_score
from linkspark.llm.mixing import op2_mix_to_targets
from linkspark.llm.pieces import op11_sentencepiece
from linkspark.llm.quality import op8_quality_classifier
from linkspark.llm.suffixes import OP3_SQL, op3_suffix_dedup
from linkspark.llm.toxicity import op6_toxicity
from linkspark.llm.urls import op10_url_filter
from linkspark.llm.vectors import op1_embedding_near_dedup
from linkspark.llm.whitening import op13_embedding_whitening

QUERIES = {
    f.__name__: f
    for f in (
        op1_embedding_near_dedup,
        op2_mix_to_targets,
        op3_suffix_dedup,
        op4_ngram_jaccard,
        op5_chat_format,
        op6_toxicity,
        op7_decontaminate,
        op8_quality_classifier,
        op9_lattice_score,
        op10_url_filter,
        op11_sentencepiece,
        op12_centroid_clusters,
        op13_embedding_whitening,
    )
}

SQL: dict[str, str] = {"op3_suffix_dedup": OP3_SQL, "op4_ngram_jaccard": OP4_SQL, "op5_chat_format": OP5_SQL, "op12_centroid_clusters": OP12_SQL}
