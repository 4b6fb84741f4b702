"""The queries of this subpackage and their SQL, by name."""

from .bilinear import op2_language_model
from .bpe import op6_bpe
from .conversations import op11_conversations
from .html_extraction import op13_html
from .media import op3_media
from .passages import op5_passages
from .periodic_runs import op12_periodic_runs
from .pseudonyms import op4_pii
from .mixing import op7_mixing
from .quality_rules import op1_quality
from .simhash import op8_simhash
from .toxicity import op10_toxicity
from .url_rules import OP9_SQL, op9_urls

QUERIES = {
    "op1_quality": op1_quality,
    "op7_mixing": op7_mixing,
    "op3_media": op3_media,
    "op4_pii": op4_pii,
    "op6_bpe": op6_bpe,
    "op8_simhash": op8_simhash,
    "op2_language_model": op2_language_model,
    "op5_passages": op5_passages,
    "op9_urls": op9_urls,
    "op10_toxicity": op10_toxicity,
    "op11_conversations": op11_conversations,
    "op12_periodic_runs": op12_periodic_runs,
    "op13_html": op13_html,
}
ORACLE_SQL: dict[str, str] = {
    "op9_urls": OP9_SQL,
}
