"""A deterministic contract corpus made from the relational tables with SQL that Spark and DuckDB both run."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

PAGES_SQL = """
select 'doc_' || cast(p_partkey % 4 as string) as document_id, cast(floor(p_partkey / 4) + 1 as int) as page_num,
  case when p_partkey % 40 < 4 then 'ARTICLE ' || cast(1 + floor(p_partkey / 40) % 30 as int) || chr(10) || 'Equipment ' || p_brand || chr(10) else '' end
  || case when p_partkey % 400 between 36 and 39 then 'EXHIBIT ' || chr(cast(65 + floor(p_partkey / 400) % 20 as int)) || chr(10) else '' end
  || cast(1 + floor(p_partkey / 40) % 30 as int) || '.' || cast(1 + floor(p_partkey / 4) % 10 as int) || ' ' || p_name || ' Pump' || chr(10)
  || 'Contractor shall furnish each ' || p_name || ' pump rated at ' || cast(p_size * 10 as string) || ' HP for ' || lower(p_type) || ' service.' || chr(10)
  || 'Configuration: ' || cast(1 + p_size % 4 as string) || ' x 50%' || chr(10)
  || p_name || ' pump | Capacity | ' || cast(p_size * 25 as string) || ' gpm' || chr(10)
  || 'The permit requirements of the authority apply to all work of the Contractor under this section at the site of the Owner.' || chr(10)
  || '- Inspect the ' || p_name || ' seal' || chr(10) || '- Record ' || lower(p_type) || ' test data' || chr(10) || '- Notify Owner' || chr(10)
  || case when p_partkey % 3 = 0 then 'Characteristic' || chr(10) || 'Rated flow' || chr(10) || cast(p_size as string) || ' gpm' || chr(10) || 'Design pressure' || chr(10) || cast(p_size * 3 as string) || ' psig' || chr(10) else '' end
  || '"Part ' || cast(p_partkey as string) || '" means the ' || p_name || ' pump supplied under this clause.' as page_text
from part
"""


def contract_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(document_id, page_num, page_text): four documents with articles, exhibits, sections, bullets, tables and definitions.

    The rows are dealt out by key before they become pages: a file of them is small, and what is made of it large.
    """
    part = spark.read.parquet(f"{sf_dir}/part.parquet").repartition(spark.sparkContext.defaultParallelism * 4, "p_partkey")
    return spark.sql(PAGES_SQL.replace("from part", "from {part}"), part=part)
