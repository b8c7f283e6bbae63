"""The queries of the operators in this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from functools import wraps

from linefacts.llm._shared import ship
from linefacts.llm.archives import OP8_SQL, op8_arc_to_warc
from linefacts.llm.context_tree import op9_context_tree
from linefacts.llm.mixing import op7_hypergeometric_mix
from linefacts.llm.near_duplicates import OP6_SQL, op6_lsh_forest_join
from linefacts.llm.order_minhash import op3_order_minhash
from linefacts.llm.packing import op2_vector_packing
from linefacts.llm.quality import OP5_SQL, op5_line_frequency
from linefacts.llm.suffix_dedup import op4_suffix_dedup
from linefacts.llm.token_index import op1_token_index
from linefacts.llm.toxicity import op10_weak_supervision



def _shipped(f):
    @wraps(f)
    def run(spark, sf_dir):
        ship(spark)
        return f(spark, sf_dir)

    return run


QUERIES = {f.__name__: _shipped(f) for f in (op1_token_index, op2_vector_packing, op3_order_minhash, op4_suffix_dedup, op5_line_frequency, op6_lsh_forest_join, op7_hypergeometric_mix, op8_arc_to_warc, op9_context_tree, op10_weak_supervision)}
SQL = {"op5_line_frequency": OP5_SQL, "op6_lsh_forest_join": OP6_SQL, "op8_arc_to_warc": OP8_SQL}
