"""Tables of pixels, boxes and labels as views over the star-schema test tables. One SQL text serves Spark and its check."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

VIEWS = {
    "v_pixels": """
select distinct case_id, tooth_id, case when case_id % 2 = 0 then a else b end as x, case when case_id % 2 = 0 then b else a end as y
from (select cast(floor(l_suppkey / 10) as int) as case_id, cast(cast((1 + l_linenumber % 4) * 10 + 6 as int) as string) as tooth_id,
        cast(l_quantity as int) + (cast(floor(l_suppkey / 10) as int) % 5 - 2) * cast(round(l_discount * 100) as int) as a,
        cast(round(l_discount * 100) as int) as b from {lineitem}) t""",
    "v_roi": """
select distinct case_id, case when case_id % 2 = 0 then a else b end as x, case when case_id % 2 = 0 then b else a end as y
from (select cast(floor(l_suppkey / 10) as int) as case_id, cast(l_quantity as int) + (cast(floor(l_suppkey / 10) as int) % 5 - 2) * cast(round(l_discount * 100) as int) as a,
        cast(round(l_discount * 100) as int) as b from {lineitem} where l_returnflag = 'R' and l_tax >= 0.07) t""",
    # decay from other columns than the masks, so that a part lies on no tooth
    "v_decay": """
select distinct cast(floor(l_suppkey / 10) as int) as case_id, cast(l_quantity as int) + (cast(l_partkey % 5 as int) - 2) * cast(round(l_tax * 100) as int) as x,
  cast(round(l_tax * 100) as int) as y from {lineitem} where l_returnflag = 'R'""",
    "v_boxes": """
select l_orderkey as case_id, l_partkey * 1000000 + l_suppkey * 10 + l_linenumber as det_id, case when l_returnflag = 'R' then 'lesion' else 'tooth' end as kind, l_tax + l_discount / 10 as confidence,
  cast(l_quantity as int) as x1, cast(round(l_discount * 100) as int) * 5 as y1, cast(l_quantity as int) + 8 + 2 * l_linenumber as x2,
  cast(round(l_discount * 100) as int) * 5 + 10 + l_linenumber as y2 from {lineitem}""",
    "v_label_pairs": """
select ((l_orderkey * 1000000 + l_partkey) * 1000 + l_suppkey % 1000) * 10 + l_linenumber as sample_id, l_orderkey as group_id, l_returnflag as y_true,
  case when l_quantity > 40 then 'A' when l_quantity > 20 then l_returnflag else 'N' end as y_pred_a,
  case when l_tax >= 0.06 then 'R' when l_discount >= 0.03 then l_returnflag else 'X' end as y_pred_b from {lineitem}""",
    "v_findings": """
select l_orderkey as case_id, (l_partkey * 1000000 + l_suppkey * 10 + l_linenumber) * 100 + cast(l_quantity as int) as id, l_linenumber as pos,
  concat('Permanent ', case when l_suppkey % 4 < 2 then 'upper' else 'lower' end, case when l_suppkey % 4 in (0, 3) then ' right ' else ' left ' end,
    case l_partkey % 9 when 0 then 'central incisor' when 1 then 'lateral incisor' when 2 then 'canine' when 3 then 'first premolar' when 4 then 'second premolar'
      when 5 then 'first molar' when 6 then 'second molar' when 7 then 'third molar' else 'root' end, ' tooth') as name,
  case l_partkey % 4 when 0 then '160770D' when 1 then '161006D' when 2 then '161166D' else 'none' end as code,
  case l_linenumber % 9 when 0 then 'Occlusal surface' when 1 then 'Mesial Surface' when 2 then ' distal ' when 3 then 'Proximal-Mesial' when 4 then 'Buccal surface'
    when 5 then 'lingual' when 6 then 'Cervical' when 7 then 'nan' else '' end as surface,
  case l_suppkey % 5 when 0 then 'Mesial' when 1 then 'Occlusal' when 2 then 'Distal' when 3 then 'Unknown' else null end as predicted,
  concat(case when l_suppkey % 4 < 2 then '1' else '4' end, cast(1 + l_partkey % 8 as int)) as tooth_id,
  l_tax * 10 as frac_m, l_discount * 5 as frac_c, 1 - l_tax * 10 as frac_d, l_quantity as x, round(l_discount * 100) as y, l_tax + l_discount as confidence, l_returnflag as flag from {lineitem}""",
    "v_proba": "select event_id as sample_id, user_id as group_id, event_type as y_true, least(0.999, value / 200.0) as p from {events}",
    "v_binary": "select l.doc_id, l.quality as y_true, case when d.n_chars > 800 then 1 else 0 end as y_pred from {labels} l join {documents} d on l.doc_id = d.doc_id",
}


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    sql = VIEWS[name]
    tables = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("lineitem", "events", "labels", "documents") if "{" + t + "}" in sql}
    return spark.sql(sql, **tables)


def with_views(sql: str, *names: str) -> str:
    """SQL for the check: the views as common table expressions before sql (which may go on with further ones)."""
    parts = [f"{n} AS ({VIEWS[n].format(lineitem='lineitem', events='events', labels='labels', documents='documents')})" for n in names]
    return "WITH " + ", ".join(parts) + (", " + sql if sql.lstrip().startswith("~") else " " + sql).replace("~", "", 1)
