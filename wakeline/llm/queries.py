"""The corpus queries and the SQL for those that SQL can express."""

from wakeline.llm import chat, decontam, topk, urlfilter
from wakeline.llm.chat import op4_chat
from wakeline.llm.decontam import op10_decontaminate
from wakeline.llm.htmltext import op5_html
from wakeline.llm.langid import op9_langid
from wakeline.llm.mixing import op3_mix
from wakeline.llm.pii import op6_pii
from wakeline.llm.simhash import op1_simhash
from wakeline.llm.topk import op8_topk
from wakeline.llm.toxicity import op2_toxicity
from wakeline.llm.urlfilter import op7_urls

QUERIES = {f.__name__: f for f in (op1_simhash, op2_toxicity, op3_mix, op4_chat, op5_html, op6_pii, op7_urls, op8_topk, op9_langid, op10_decontaminate)}

ORACLE = {"op4_chat": chat.ORACLE, "op7_urls": urlfilter.ORACLE, "op8_topk": topk.ORACLE, "op10_decontaminate": decontam.ORACLE}
