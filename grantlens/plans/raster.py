"""Jobs over pixel tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from grantlens.operators import raster as O
from grantlens.plans.registry import job
from grantlens.plans.views import PIXELS, pixels

_P = f"p as ({PIXELS})"
_STATS = """st as (select image_id, count(*) as n, max(x) + 1 as width, max(y) + 1 as height, sum(lum) * 1.0::double / count(*) as mean_lum,
 sqrt(greatest(0, sum(lum * lum) * 1.0::double / count(*) - (sum(lum) * 1.0::double / count(*)) * (sum(lum) * 1.0::double / count(*)))) as std_lum from p group by 1)"""
_LAP = """lp as (select c.image_id, c.x, c.y, cast(l.lum + r.lum + u.lum + d.lum - 4 * c.lum as double) as v from p c join p l on l.image_id = c.image_id and l.x = c.x - 1 and l.y = c.y
 join p r on r.image_id = c.image_id and r.x = c.x + 1 and r.y = c.y join p u on u.image_id = c.image_id and u.x = c.x and u.y = c.y - 1 join p d on d.image_id = c.image_id and d.x = c.x and d.y = c.y + 1),
lv as (select image_id, greatest(0, sum(v * v) / count(*) - (sum(v) / count(*)) * (sum(v) / count(*))) as laplacian_var from lp group by 1)"""
_OTSU = f"""h as (select image_id, lum, count(*) as n from p group by 1, 2),
c as (select image_id, lum, sum(n) over w as wb, sum(lum * n) over w as sb, sum(n) over (partition by image_id) as total, sum(lum * n) over (partition by image_id) as mass from h window w as (partition by image_id order by lum)),
b as (select *, cast(wb as double) * (total - wb) * power(sb * 1.0::double / wb - (mass - sb) * 1.0::double / (total - wb), 2) as between_var from c where total > wb),
o as (select image_id, cast(greatest({O.OTSU_LOW}, least({O.OTSU_HIGH}, lum)) as integer) as threshold from (select *, row_number() over (partition by image_id order by round(between_var, 6) desc, lum) as rn from b) where rn = 1)"""


@job("luminance_stats", "I1", sql=f"with {_P}, {_STATS} select image_id, n, width, height, round(mean_lum, 6) as mean_lum, round(std_lum, 6) as std_lum from st")
def luminance_stats(spark, base):
    return O.luminance_stats(pixels(spark, base)).withColumns({c: F.round(c, 6) for c in ("mean_lum", "std_lum")})


@job("laplacian_variance", "I2", sql=f"with {_P}, {_LAP} select image_id, round(laplacian_var, 4) as laplacian_var from lv")
def laplacian_variance(spark, base):
    return O.laplacian_variance(pixels(spark, base)).withColumn("laplacian_var", F.round("laplacian_var", 4))


@job("otsu_threshold", "I3", sql=f"with {_P}, {_OTSU} select image_id, threshold from o")
def otsu_threshold(spark, base):
    return O.otsu_threshold(pixels(spark, base))


# Source sizes vary by image so that every resolution score occurs.
_SIZES = "sz as (select distinct image_id, cast(300 + image_id * 37 % 1200 as integer) as width, cast(350 + image_id * 53 % 1500 as integer) as height from p)"
_SCORED = f"""{_P}, {_STATS}, {_LAP}, {_SIZES}, m as (select st.image_id, sz.width, sz.height, mean_lum, std_lum, laplacian_var, sz.width * sz.height as area from st join sz using (image_id) join lv using (image_id)),
f as (select *, width < 400 or height < 400 or area < 200000 as tiny, least(width, height) < 600 or area < 500000 as small from m),
q as (select *, cast(case when tiny then 30 when small then 65 when area >= 1000000 then 100 else least(100, floor(area / 1000000.0 * 100 + 0.5)) end as bigint) as resolution_score,
 case when mean_lum < 45 then 30 when mean_lum < 75 then 60 when mean_lum > 250 then 40 when mean_lum > 242 then 75 else 100 end as brightness_score,
 cast(case when std_lum < 15 then 20 when std_lum < 28 then 55 else least(100, floor(std_lum / 60 * 100 + 0.5)) end as bigint) as contrast_score,
 cast(case when laplacian_var < 40 then 25 when laplacian_var < 100 then 60 else least(100, floor(laplacian_var / 250 * 100 + 0.5)) end as bigint) as sharpness_score,
 list_filter([case when tiny then 'resolution' end, case when mean_lum < 45 then 'dark' when mean_lum > 250 then 'washed_out' end, case when std_lum < 15 then 'flat' end, case when laplacian_var < 40 then 'blurry' end], lambda x: x is not null) as issues,
 list_filter([case when not tiny and small then 'resolution' end, case when mean_lum >= 45 and mean_lum < 75 then 'dark' when mean_lum > 242 and mean_lum <= 250 then 'bright' end, case when std_lum >= 15 and std_lum < 28 then 'low_contrast' end,
  case when laplacian_var >= 40 and laplacian_var < 100 then 'mild_blur' end], lambda x: x is not null) as warnings from f),
s as (select *, case when len(issues) > 0 or contrast_score < 30 then 'poor' when len(warnings) > 0 or resolution_score < 70 or sharpness_score < 70 or brightness_score < 70 or contrast_score < 60 then 'fair' else 'good' end as level from q)"""


def _quality(spark, base):
    p = pixels(spark, base)
    i = F.col("image_id")
    sizes = p.select("image_id").distinct().select("image_id", (300 + i * 37 % 1200).cast("int").alias("width"), (350 + i * 53 % 1500).cast("int").alias("height"))
    return p, O.quality_score(p, dimensions=sizes)


@job("quality_score", "I4", sql=f"""with {_SCORED} select image_id, width, height, resolution_score, brightness_score, contrast_score, sharpness_score, level,
 array_to_string(issues, ',') as issues, array_to_string(warnings, ',') as warnings, level <> 'poor' or len(issues) <= 1 as is_usable from s""")
def quality_score(spark, base):
    _, q = _quality(spark, base)
    return q.select("image_id", "width", "height", F.col("resolution_score").cast("bigint").alias("resolution_score"), "brightness_score", F.col("contrast_score").cast("bigint").alias("contrast_score"),
                    F.col("sharpness_score").cast("bigint").alias("sharpness_score"), "level", F.array_join("issues", ",").alias("issues"), F.array_join("warnings", ",").alias("warnings"), "is_usable")


_GATE = f"""{_SCORED}, g0 as (select *, list_filter([case when resolution_score < 35 or width < 350 then 'low resolution' end, case when sharpness_score < 30 or floor(laplacian_var + 0.5) < 30 then 'blurry' end,
 case when floor(mean_lum + 0.5) < 40 then 'too dark' end, case when floor(mean_lum + 0.5) > 252 then 'washed out / overexposed' end, case when contrast_score < 20 or floor(std_lum + 0.5) < 12 then 'low contrast / blank page' end], lambda x: x is not null) as reasons from s),
g as (select *, case when len(reasons) >= 2 or list_contains(reasons, 'low contrast / blank page') then 'REJECT' when len(reasons) > 0 or level = 'fair' then 'WARN' else 'PASS' end as gate from g0)"""


@job("quality_gate", "I5", "I10", sql=f"""with {_GATE} select image_id, array_to_string(reasons, ',') as reasons, gate,
 case when sharpness_score < 60 then 'sharpened' when floor(mean_lum + 0.5) < 60 or contrast_score < 50 then 'contrast' when floor(mean_lum + 0.5) > 220 then 'binarized' else 'contrast' end as profile from g""")
def quality_gate(spark, base):
    _, q = _quality(spark, base)
    g = O.quality_gate(q).select("image_id", F.array_join("reasons", ",").alias("reasons"), "gate")
    return g.join(O.choose_profile(q), "image_id")


_STRETCH = """pr as (select image_id, case when brightness_score < 60 then 1.30 when floor(mean_lum + 0.5) > 220 then 1.40 when contrast_score < 50 then 1.35 else 1.20 end::double as factor,
 case when brightness_score < 60 then 20 when floor(mean_lum + 0.5) > 220 then -15 else 0 end as shift from s),
sx as (select p.image_id, x, y, cast(floor(round(greatest(0, least(255, (lum - 128) * factor + 128 + shift)), 6) + 0.5) as integer) as lum from p join pr using (image_id))"""


@job("contrast_stretch", "I7", sql=f"with {_SCORED}, {_STRETCH} select * from sx")
def contrast_stretch(spark, base):
    p, q = _quality(spark, base)
    return O.contrast_stretch(p, O.stretch_parameters(q))


@job("quality_recheck", "I6")
def quality_recheck(spark, base):
    p, q = _quality(spark, base)
    enhanced = O.contrast_stretch(p, O.stretch_parameters(q))
    return O.quality_recheck(q, O.quality_score(enhanced, dimensions=q.select("image_id", "width", "height")))


@job("illumination_normalized", "I8", sql=f"""with {_P}, bg as (select image_id, avg(lum) as bg from p where x % 40 % 4 = 0 and y % 40 % 4 = 0 group by 1, x // 40, y // 40)
select image_id, x, y, cast(greatest(0, least(255, floor(round(lum / greatest(15, bg) * 200, 6) + 0.5))) as integer) as lum from p join bg using (image_id)""")
def illumination_normalized(spark, base):
    return O.illumination_normalize(pixels(spark, base))


@job("binarized", "I9", sql=f"with {_P}, {_OTSU} select image_id, x, y, case when lum < threshold then 0 else 255 end as lum from p join o using (image_id)")
def binarized(spark, base):
    return O.binarize(pixels(spark, base))


@job("sharpened", "I9", sql=f"""with {_P}, n as (select c.image_id, c.x, c.y, c.lum, l.lum as a, r.lum as b, u.lum as e, d.lum as f from p c left join p l on l.image_id = c.image_id and l.x = c.x - 1 and l.y = c.y
 left join p r on r.image_id = c.image_id and r.x = c.x + 1 and r.y = c.y left join p u on u.image_id = c.image_id and u.x = c.x and u.y = c.y - 1 left join p d on d.image_id = c.image_id and d.x = c.x and d.y = c.y + 1)
select image_id, x, y, case when a is null or b is null or e is null or f is null then lum else cast(greatest(0, least(255, floor(round(3.4::double * lum - 0.6::double * (a + b + e + f), 6) + 0.5))) as integer) end as lum from n""")
def sharpened(spark, base):
    return O.convolve3x3(pixels(spark, base), min_side=3)
