"""The queries of the training-data operators, and SQL for those that SQL can express."""

from __future__ import annotations

from . import chat, gbt, licenses, linedup, lsh, minhash, mixing, mtree, packing, toxicity


def queries():
    return {
        "op1_perspective_rotation": chat.query,
        "perspective_dialogues": chat.dialogues,
        "op2_mtree_topk": mtree.query,
        "op3_license_scan": licenses.query,
        "op4_collision_counting": lsh.query,
        "op5_line_chunks": linedup.query,
        "op6_source_mix": mixing.query,
        "op7_minhash_components": minhash.query,
        "op8_ftrl_toxicity": toxicity.query,
        "op9_concat_packing": packing.query,
        "op10_quality_trees": gbt.query,
    }


def oracle_sql():
    return {
        "op1_perspective_rotation": chat.ORACLE_SQL,
        "perspective_dialogues": chat.DIALOGUES_SQL,
        "op2_mtree_topk": mtree.ORACLE_SQL,
        "op3_license_scan": licenses.ORACLE_SQL,
        "op6_source_mix": mixing.ORACLE_SQL,
        "op7_minhash_components": minhash.ORACLE_SQL,
    }
