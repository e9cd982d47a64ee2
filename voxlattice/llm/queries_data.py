"""Queries over the documents, pages and embeddings tables: packing and mixing."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, table
from .mixing import mixing_plan
from .packing import best_fit_packing
from .warc import Archive

#: Public vocabulary files; the path is a parameter of every operator that reads one.
BYTE_BPE, WORD_BPE = (public_tokenizers.path(f"{name}.json") for name in ("byte_bpe_50k", "word_bpe_49k"))


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best_fit_packing(table(spark, sf_dir, "documents"), BYTE_BPE)


def op9_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = mixing_plan(table(spark, sf_dir, "documents").select("doc_id", "text", "source"), Scratch(spark, "op9"))
    return plan.select("doc_id", "size", "source_size", "target", (F.col("size") * F.size("shards")).alias("taken"))


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    archive = Archive(Scratch(spark, "op10"))
    places = archive.write(table(spark, sf_dir, "pages"))
    archive.index(places)
    return archive.look_up(places).drop("payload")


QUERIES = {"op10_warc": op10_warc, "op3_best_fit_packing": op3_best_fit_packing, "op9_mix_sources": op9_mix_sources}

SQL = {
    "op10_warc": """
with p as (
  select page_id, encode(coalesce(html, '')) as body, sha1(coalesce(html, '')) as digest from pages),
k as (select digest, max(page_id) as keep from p where octet_length(body) >= 1000 group by digest having count(*) > 1)
select page_id, cast(octet_length(body) as bigint) as payload_bytes, p.digest as payload_digest,
  case when keep <> page_id then 'revisit' else 'response' end as record_type,
  case when keep <> page_id then keep end as refers_to
from p left join k on p.digest = k.digest
""",
    "op9_mix_sources": r"""
with d as (
  select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) as size,
    cast('0x' || substr(md5('mix|' || coalesce(cast(doc_id as varchar), 'null') || '|' || coalesce(md5(text), 'null')), 1, 15) as bigint) as h
  from documents),
n as (select *, row_number() over (partition by source, h) as place from d),
s0 as (
  select source, cast(sum(size) as bigint) as source_size,
    row_number() over (order by source is null, encode(source)) - 1 as no from d group by source),
s1 as (select *, 1 + no % 3 as w, 3 * source_size as most from s0),
s2 as (
  select *, coalesce(sum(most) over (r rows between unbounded preceding and 1 preceding), 0) as stopped,
    sum(w) over (r rows between current row and unbounded following) as ws, sum(source_size) over () as total, row_number() over r as turn
  from s1 window r as (order by most / w, source is null, source)),
s3 as (select *, cast(total - stopped as double) / cast(ws as double) as level from s2),
s4 as (select *, (select arg_min(level, turn) from s3 where level * w <= most) as l from s3),
s as (
  select source, source_size, no, case when l is null then cast(most as double) else least(cast(most as double), l * w) end as target from s4),
s5 as (
  select *, case when source_size > 0 then floor(target / source_size) else 0 end as passes from s),
b as (
  select s5.*, target - passes * source_size as rest, h % 256 as block, sum(size) as words
  from d join s5 on d.source is not distinct from s5.source group by all),
b2 as (
  select *, sum(words) over (partition by no order by cast('0x' || substr(md5('mix|block|' || no || '|' || block), 1, 15) as bigint), block) as upto from b),
b3 as (select *, upto <= rest as drawn, upto > rest and rest - upto + words > 0 as parted, rest - upto + words as gap from b2),
i as (
  select d.source, h, gap, max(size) as each, count(*) as c, sum(size) as whole
  from d join b3 on d.source is not distinct from b3.source and h % 256 = block and parted group by all),
i2 as (
  select *, coalesce(sum(whole) over (partition by source order by h rows between unbounded preceding and 1 preceding), 0) as before from i),
i3 as (
  select *, case when each > 0 then least(greatest(floor((gap - before) / each + 0.5), 0), c) when before <= gap then c else 0 end as fit from i2),
e as (select source, max(h) as bound, arg_max(fit, h) as fit from i3 where fit > 0 group by source)
select n.doc_id, cast(n.size as bigint) as size, b3.source_size, b3.target,
  cast(n.size * (b3.passes + case when drawn or (parted and (h < e.bound or (h = e.bound and place <= e.fit))) then 1 else 0 end) as bigint) as taken
from n join b3 on n.source is not distinct from b3.source and n.h % 256 = b3.block
  left join e on n.source is not distinct from e.source
""",
}
