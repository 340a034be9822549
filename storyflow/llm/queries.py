"""Queries of the training-data operators, and their SQL where SQL has one."""

from __future__ import annotations

from storyflow.llm.audio import op2_media
from storyflow.llm.bpe import op7_bpe
from storyflow.llm.centroids import SQL as CENTROIDS_SQL
from storyflow.llm.centroids import op11_centroids
from storyflow.llm.chat import SQL as CHAT_SQL
from storyflow.llm.chat import op8_chat
from storyflow.llm.decontaminate import SQL as DECONTAMINATE_SQL
from storyflow.llm.decontaminate import op4_decontaminate
from storyflow.llm.langid import op3_langid
from storyflow.llm.lmscore import op5_lm
from storyflow.llm.negatives import SQL as NEGATIVES_SQL
from storyflow.llm.negatives import op12_negatives
from storyflow.llm.pieces import op13_sentencepiece
from storyflow.llm.secretscan import op10_secrets
from storyflow.llm.simhash import op1_simhash
from storyflow.llm.urlfilter import op9_urls
from storyflow.llm.warc import SQL as WARC_SQL
from storyflow.llm.warc import op6_warc

QUERIES = {
    "op1_simhash": op1_simhash,
    "op2_media": op2_media,
    "op3_langid": op3_langid,
    "op4_decontaminate": op4_decontaminate,
    "op5_lm": op5_lm,
    "op6_warc": op6_warc,
    "op7_bpe": op7_bpe,
    "op8_chat": op8_chat,
    "op9_urls": op9_urls,
    "op10_secrets": op10_secrets,
    "op11_centroids": op11_centroids,
    "op12_negatives": op12_negatives,
    "op13_sentencepiece": op13_sentencepiece,
}

ORACLES: dict[str, str] = {"op4_decontaminate": DECONTAMINATE_SQL, "op6_warc": WARC_SQL, "op8_chat": CHAT_SQL, "op11_centroids": CENTROIDS_SQL, "op12_negatives": NEGATIVES_SQL}
