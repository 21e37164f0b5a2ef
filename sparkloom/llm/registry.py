"""The queries of this subpackage by name, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from sparkloom.llm import exact_dedup, quality_rules, warc
from sparkloom.llm.bpe import op2_bpe
from sparkloom.llm.exact_dedup import op3_exact_dedup
from sparkloom.llm.mixing import op6_mixing
from sparkloom.llm.pii import op10_pii
from sparkloom.llm.quality_rules import op8_quality_rules
from sparkloom.llm.ranking import op5_ranking
from sparkloom.llm.records import op1_token_records
from sparkloom.llm.sharding import op7_sharding
from sparkloom.llm.simhash import op9_simhash
from sparkloom.llm.warc import op4_warc


def queries() -> dict:
    return {
        "op1_token_records": op1_token_records,
        "op2_bpe": op2_bpe,
        "op3_exact_dedup": op3_exact_dedup,
        "op4_warc": op4_warc,
        "op5_ranking": op5_ranking,
        "op6_mixing": op6_mixing,
        "op7_sharding": op7_sharding,
        "op8_quality_rules": op8_quality_rules,
        "op9_simhash": op9_simhash,
        "op10_pii": op10_pii,
    }


def oracle_sql() -> dict[str, str]:
    return {"op3_exact_dedup": exact_dedup.ORACLE_SQL, "op4_warc": warc.ORACLE_SQL, "op8_quality_rules": quality_rules.ORACLE_SQL}
