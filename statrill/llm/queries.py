"""The queries of this subpackage and their SQL, by name."""

from __future__ import annotations

from .bpe import op8_byte_bpe
from .conversations import ORACLE_SQL as CONVERSATIONS_SQL
from .conversations import op13_conversation_repair
from .fill_middle import ORACLE_SQL as MIDDLE_SQL
from .fill_middle import op12_fill_middle
from .licenses import ORACLE_SQL as LICENCES_SQL
from .licenses import op3_licences
from .line_dedup import op1_line_dedup
from .line_rules import ORACLE_SQL as RULES_SQL
from .line_rules import op11_quality_rules
from .ngram_join import ORACLE_SQL as NGRAM_SQL
from .ngram_join import op4_ngram_join
from .packing import op10_best_fit_packing
from .pii import op9_pii
from .quality import op7_quality
from .secrets import ORACLE_SQL as SECRETS_SQL
from .secrets import op5_secrets
from .spotsigs import op2_spot_signatures
from .topk import ORACLE_SQL as TOP_K_SQL
from .topk import op6_bit_sliced_top_k

QUERIES = {f.__name__: f for f in (op1_line_dedup, op2_spot_signatures, op3_licences, op4_ngram_join, op5_secrets, op6_bit_sliced_top_k, op7_quality, op8_byte_bpe, op9_pii, op10_best_fit_packing, op11_quality_rules, op12_fill_middle, op13_conversation_repair)}
ORACLE_SQL: dict[str, str] = {**CONVERSATIONS_SQL, **LICENCES_SQL, **MIDDLE_SQL, **NGRAM_SQL, **RULES_SQL, **SECRETS_SQL, **TOP_K_SQL}
