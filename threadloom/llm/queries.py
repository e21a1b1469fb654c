"""The operators' queries over their whole tables, and SQL where it can express them."""

from threadloom.llm.bpe import op3_bpe
from threadloom.llm.hamming import OP2_SQL, op2_near_embeddings
from threadloom.llm.licenses import OP10_SQL, op10_license_scan
from threadloom.llm.minhash import OP7_SQL, op7_minhash_dedup
from threadloom.llm.mixing import op4_mixing
from threadloom.llm.quality import op6_quality
from threadloom.llm.secrets import op1_secret_scan
from threadloom.llm.toxicity import op9_toxicity
from threadloom.llm.unigram import op8_token_counts
from threadloom.llm.warc import OP5_SQL, op5_warc

QUERIES = {f.__name__: f for f in (op1_secret_scan, op2_near_embeddings, op3_bpe, op4_mixing, op5_warc, op6_quality, op7_minhash_dedup, op8_token_counts, op9_toxicity, op10_license_scan)}

ORACLES = {"op2_near_embeddings": OP2_SQL, "op5_warc": OP5_SQL, "op7_minhash_dedup": OP7_SQL, "op10_license_scan": OP10_SQL}
