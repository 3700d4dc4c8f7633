"""Registered queries of the numbered operators."""

from .decontaminate import op10_decontaminate
from .langid import op6_langid
from .middle import SQL as MIDDLE_SQL
from .middle import op11_middle
from .passages import op9_passages
from .pitman_yor import op3_pitman_yor
from .quality import op5_nbsvm
from .ranked import SQL as RANKED_SQL
from .ranked import op13_ranked
from .rules import op7_rules
from .simhash import op2_simhash
from .tokens import op8_bpe
from .toxicity import op12_toxicity
from .warc import op1_warc
from .wrappers import op4_wrappers

QUERIES = {f.__name__: f for f in (op1_warc, op2_simhash, op3_pitman_yor, op4_wrappers, op5_nbsvm, op6_langid, op7_rules, op8_bpe, op9_passages, op10_decontaminate, op11_middle, op12_toxicity, op13_ranked)}
#: The others have no SQL form that runs on whole tables; tests/llm holds them against brute force.
ORACLES: dict[str, str] = {"op11_middle": MIDDLE_SQL, "op13_ranked": RANKED_SQL}
