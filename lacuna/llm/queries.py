"""The queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from .chat import OP7_SQL, op7_chat
from .codes import OP13_SQL, op13_heap_lloyd
from .language import op6_language
from .licenses import op8_licences
from .media import op3_mpeg_audio
from .mixing import op2_pfair_mix
from .negatives import OP11_SQL, op11_voronoi_negatives
from .ngram_join import OP4_SQL, op4_parity_join
from .packing import op5_packing
from .pieces import op12_distinct_chunks
from .quality import op10_quality
from .sharding import op9_virtual_slots
from .toxicity import op1_toxicity

QUERIES = {
    f.__name__: f
    for f in (op1_toxicity, op2_pfair_mix, op3_mpeg_audio, op4_parity_join, op5_packing, op6_language, op7_chat, op8_licences, op9_virtual_slots, op10_quality, op11_voronoi_negatives, op12_distinct_chunks, op13_heap_lloyd)
}
ORACLES: dict[str, str] = {"op4_parity_join": OP4_SQL, "op7_chat": OP7_SQL, "op11_voronoi_negatives": OP11_SQL, "op13_heap_lloyd": OP13_SQL}
