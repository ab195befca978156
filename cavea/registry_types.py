"""Queries of the default typing (bridged mouths, necks, refined types) and their oracle SQL.

The SQL types components from the voxels on: mouths and their shells, the shortest way
between two shells, breadth-first depths from each effective mouth, necks and final types.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from . import views
from .operators import graph, metrics, prep, topology, voxels
from .operators.voxels import SID
from .plans import annotate
from .registry import CFG, STEPS, query
from .registry_more import ATOM_SQL, MOUTHS, _atoms, _mouths
from .registry_rows import TYPES

KEYS = [SID, "comp"]

#: Shells of mouths, and where two shells meet within one voxel between them.
SHELLS = f""",
mv AS (SELECT mo.mouth, ds.* FROM mo JOIN ds USING (structure_id, flat)),
sh AS (SELECT structure_id, comp, mouth, flat FROM mv UNION SELECT cv.structure_id, cv.comp, mouth, cv.flat FROM mv, {STEPS}, cv WHERE cv.structure_id=mv.structure_id AND cv.comp=mv.comp AND cv.vx=mv.vx+dx AND cv.vy=mv.vy+dy AND cv.vz=mv.vz+dz),
tw AS (SELECT structure_id, comp, min(mouth) AS m1, max(mouth) AS m2 FROM sh GROUP BY ALL HAVING count(DISTINCT mouth) = 2),
b0 AS (SELECT structure_id, comp, flat FROM sh JOIN tw USING (structure_id, comp) WHERE mouth = m1),
ot AS (SELECT structure_id, comp, flat FROM sh JOIN tw USING (structure_id, comp) WHERE mouth = m2),
b1 AS (SELECT b0.structure_id, comp, lk.b AS flat, min(lk.a) AS pred FROM b0 JOIN lk ON lk.structure_id=b0.structure_id AND lk.a=b0.flat ANTI JOIN b0 z ON z.structure_id=b0.structure_id AND z.flat=lk.b GROUP BY ALL),
b2 AS (SELECT b1.structure_id, comp, lk.b AS flat, min(lk.a) AS pred FROM b1 JOIN lk ON lk.structure_id=b1.structure_id AND lk.a=b1.flat ANTI JOIN b0 z ON z.structure_id=b1.structure_id AND z.flat=lk.b ANTI JOIN b1 y ON y.structure_id=b1.structure_id AND y.flat=lk.b GROUP BY ALL),
hi AS (SELECT DISTINCT ON (structure_id, comp) structure_id, comp, depth, pred FROM
  (SELECT structure_id, comp, flat, 0 AS depth, NULL::BIGINT AS pred FROM b0 UNION ALL SELECT structure_id, comp, flat, 1, pred FROM b1 UNION ALL SELECT structure_id, comp, flat, 2, pred FROM b2) JOIN ot USING (structure_id, comp, flat)
  ORDER BY structure_id, comp, depth, flat),
ef AS (SELECT structure_id, comp, CASE WHEN hi.depth IS NULL THEN mouth ELSE m1 END AS mouth, flat FROM sh LEFT JOIN hi USING (structure_id, comp) LEFT JOIN tw USING (structure_id, comp)
  UNION SELECT structure_id, comp, m1, pred FROM hi JOIN tw USING (structure_id, comp) WHERE depth = 2)"""
#: Topology types with bridged mouths, and depths from each mouth of pockets and pores.
DEPTHS = TYPES + SHELLS + """,
ty AS (SELECT structure_id, comp, n, coalesce(nd, 0) AS nd, coalesce(m, 0) AS m, CASE WHEN n <= 4 THEN 'occluded' WHEN nd IS NULL THEN 'cavity' WHEN m >= 3 THEN 'hub'
  WHEN m = 2 AND coalesce(l[5], 0) >= l[1] * 0.4::DOUBLE THEN 'hub' WHEN m = 2 AND hi.depth IS NOT NULL THEN 'pocket' WHEN m = 2 THEN 'pore' WHEN nd < 24 THEN 'pocket'
  WHEN coalesce(l[3], 0) >= l[1] * 0.4::DOUBLE THEN 'hub' WHEN coalesce(l[2], 0) >= l[1] * 0.7::DOUBLE THEN 'pore' ELSE 'pocket' END AS type
  FROM al LEFT JOIN nm USING (structure_id, comp) LEFT JOIN bs USING (structure_id, comp) LEFT JOIN hi USING (structure_id, comp)),
tr AS (SELECT ef.* FROM ef JOIN ty USING (structure_id, comp) WHERE type IN ('pocket', 'pore')),
bf(structure_id, mouth, flat, depth) USING KEY (structure_id, mouth, flat) AS (
  SELECT structure_id, mouth, flat, 0 FROM tr
  UNION SELECT bf.structure_id, bf.mouth, lk.b, bf.depth + 1 FROM bf JOIN lk ON lk.structure_id=bf.structure_id AND lk.a=bf.flat
  LEFT JOIN recurring.bf r ON r.structure_id=bf.structure_id AND r.mouth=bf.mouth AND r.flat=lk.b WHERE r.flat IS NULL)"""
#: Necks of mouths, and final types.
FINAL = DEPTHS + """,
ew AS (SELECT structure_id, comp, mouth, count(*) AS shell FROM tr GROUP BY ALL),
lw AS (SELECT structure_id, mouth, depth, count(*) AS c FROM bf WHERE depth > 0 GROUP BY ALL),
cu AS (SELECT *, sum(c) OVER (PARTITION BY structure_id, mouth ORDER BY depth) AS s FROM lw),
nk AS (SELECT structure_id, comp, ew.mouth, shell, min(c) FILTER (WHERE s - c < shell) AS neck FROM ew LEFT JOIN cu USING (structure_id, mouth) GROUP BY ALL),
fl AS (SELECT structure_id, comp, mouth, coalesce(neck <= 1, false) AS narrow, coalesce(neck <= 1, false) AND n - shell > 0 AND (n - shell) / shell > 500 AS necked FROM nk JOIN ty USING (structure_id, comp)),
pm AS (SELECT structure_id, comp, count(*) AS mouths, count(*) FILTER (WHERE NOT narrow) AS wide, bool_or(necked) AS necked FROM fl GROUP BY ALL),
fi AS (SELECT structure_id, comp, n, nd, m, type, CASE WHEN type = 'pocket' AND mouths = 1 AND necked THEN 'cavity' WHEN type = 'pore' AND mouths IS NULL THEN 'cavity'
  WHEN type = 'pore' AND mouths = 1 THEN CASE WHEN necked THEN 'cavity' ELSE 'pocket' END
  WHEN type = 'pore' AND mouths >= 2 THEN CASE WHEN wide = 0 THEN 'cavity' WHEN wide = 1 THEN 'pocket' ELSE 'pore' END ELSE type END AS final_type
  FROM ty LEFT JOIN pm USING (structure_id, comp))"""


@query(FINAL + " SELECT structure_id, comp, n AS num_voxels, nd AS num_direct, m AS num_mouths, type, final_type FROM fi")
def g05_typed_components(spark, d):
    grids, occupied, buried = annotate.occupied_and_buried(views.v_points(spark, d), CFG)
    types, _ = topology.typed_components(topology.voxel_components(buried), occupied, grids, CFG, voxels.exposed_contacts(buried, occupied, grids))
    return types.select(SID, "comp", "num_voxels", "num_direct", "num_mouths", "type", "final_type")


@query(MOUTHS + SHELLS + " SELECT structure_id, comp, CASE WHEN depth = 2 THEN [pred] ELSE []::BIGINT[] END::VARCHAR AS bridge FROM hi")
def g03_mouth_bridges(spark, d):
    """Components whose two mouths are one, with the voxel between their shells."""
    typed, _, patches = _mouths(spark, d)
    found = topology.mouth_bridge(topology.mouth_shells(patches, typed), typed, CFG.merge_gap)
    return found.select(*KEYS, F.concat(F.lit("["), F.concat_ws(", ", F.col("bridge").cast("array<string>")), F.lit("]")).alias("bridge"))


#: Depths from the shell of every mouth, whatever the type.
WALKS = MOUTHS + SHELLS + """,
bf(structure_id, mouth, flat, depth) USING KEY (structure_id, mouth, flat) AS (
  SELECT structure_id, mouth, flat, 0 FROM sh
  UNION SELECT bf.structure_id, bf.mouth, lk.b, bf.depth + 1 FROM bf JOIN lk ON lk.structure_id=bf.structure_id AND lk.a=bf.flat
  LEFT JOIN recurring.bf r ON r.structure_id=bf.structure_id AND r.mouth=bf.mouth AND r.flat=lk.b WHERE r.flat IS NULL)"""


@query(WALKS + " SELECT structure_id, comp, mouth, flat, depth FROM bf JOIN cv USING (structure_id, flat)")
def g04_layers(spark, d):
    """Depth of each voxel of a component from the shell of each of its mouths."""
    typed, _, patches = _mouths(spark, d)
    shells = topology.mouth_shells(patches, typed)
    links = voxels.face_links(typed, KEYS)
    links = links.unionByName(links.select(*KEYS, F.col("b").alias("a"), F.col("a").alias("b"))).join(shells.select(*KEYS, "mouth").distinct(), KEYS)
    found = graph.layers(shells.select(*KEYS, "mouth", F.col("flat").alias("n")), links, [*KEYS, "mouth"])
    return found.select(*KEYS, "mouth", F.col("n").alias("flat"), "depth")


@query(WALKS + """, sz2 AS (SELECT structure_id, mouth, count(*) AS shell FROM sh GROUP BY ALL), lw AS (SELECT structure_id, mouth, depth, count(*) AS c FROM bf WHERE depth > 0 GROUP BY ALL),
cu AS (SELECT *, sum(c) OVER (PARTITION BY structure_id, mouth ORDER BY depth) AS s FROM lw)
SELECT structure_id, mouth, shell, depth, c FROM cu JOIN sz2 USING (structure_id, mouth) WHERE s - c < shell""")
def w12_layers_until_shell(spark, d):
    """The first interior layers of each mouth, up to the one by which they hold as many
    voxels as its shell."""
    typed, _, patches = _mouths(spark, d)
    widths = topology.layer_widths(topology.mouth_shells(patches, typed), typed)
    return topology.layers_until_shell(widths, [*KEYS, "mouth"]).select(SID, "mouth", "shell", "depth", "c")


@query(FINAL + """, su2 AS (SELECT structure_id, comp, mouth FROM fl JOIN fi USING (structure_id, comp) WHERE final_type = 'cavity' OR (type = 'pore' AND narrow AND (SELECT count(*) FROM fl f2 WHERE f2.structure_id=fl.structure_id AND f2.comp=fl.comp) >= 2)),
sv AS (SELECT DISTINCT ef.structure_id, ef.comp, ef.flat FROM ef JOIN fi ON fi.structure_id=ef.structure_id AND fi.comp=ef.comp AND final_type <> 'occluded' ANTI JOIN su2 ON su2.structure_id=ef.structure_id AND su2.comp=ef.comp AND su2.mouth=ef.mouth),
rk AS (SELECT structure_id, comp, final_type AS type, (row_number() OVER (PARTITION BY structure_id, final_type ORDER BY n DESC, CASE type WHEN 'hub' THEN 0 WHEN 'pore' THEN 1 WHEN 'pocket' THEN 2 ELSE 3 END, comp) - 1)::INT AS id FROM fi WHERE n >= 4 AND final_type <> 'occluded')
SELECT cv.structure_id, type, id, cv.flat, sv.flat IS NOT NULL AS is_surface FROM rk JOIN cv USING (structure_id, comp) LEFT JOIN sv ON sv.structure_id=cv.structure_id AND sv.flat=cv.flat""")
def j11_marked_surface(spark, d):
    """Every voxel of every volume under the volume's id, with the final surface marked."""
    return annotate.annotate_volumes(views.v_points(spark, d), CFG)[1].select(SID, "type", "id", "flat", "is_surface")


# shapes


def _cross(a: str, b: str) -> str:
    return f"[{a}[2]*{b}[3]-{a}[3]*{b}[2], {a}[3]*{b}[1]-{a}[1]*{b}[3], {a}[1]*{b}[2]-{a}[2]*{b}[1]]"


def _unit(a: str) -> str:
    return f"list_transform({a}, lambda x: x / sqrt(list_inner_product({a}, {a})))"


def _across(u: str) -> str:
    """Across u: the coordinate axis it has least of, without its part along u."""
    least = f"least(abs({u}[1]), abs({u}[2]), abs({u}[3])) + 1e-9"
    axis = {k: f"[{', '.join(f'{int(i == k)}-{u}[{k}]*{u}[{i}]' for i in (1, 2, 3))}]" for k in (1, 2, 3)}
    return f"CASE WHEN abs({u}[1]) <= {least} THEN {axis[1]} WHEN abs({u}[2]) <= {least} THEN {axis[2]} ELSE {axis[3]} END"


def _sided(v: str, sign: int) -> str:
    """v with its largest component (the first of equals) of the given sign."""
    most = f"greatest(abs({v}[1]), abs({v}[2]), abs({v}[3])) - 1e-9"
    return f"list_transform({v}, lambda x: x * {sign} * sign(CASE WHEN abs({v}[1]) >= {most} THEN {v}[1] WHEN abs({v}[2]) >= {most} THEN {v}[2] ELSE {v}[3] END))"


def axes_sql(src: str, out: str) -> str:
    """CTEs that end in ``out``: the rows of ``src`` (xx, xy, xz, yy, yz, zz) with e1 to e3,
    eigenvalues in closed form, and v1 to v3, their vectors from cross products."""
    best = lambda k: f"CASE WHEN list_inner_product(a{k}, a{k}) >= greatest(list_inner_product(b{k}, b{k}), list_inner_product(c{k}, c{k})) THEN a{k} WHEN list_inner_product(b{k}, b{k}) >= list_inner_product(c{k}, c{k}) THEN b{k} ELSE c{k} END"
    rows = ", ".join(f"[xx-e{k}, xy, xz] AS r{k}1, [xy, yy-e{k}, yz] AS r{k}2, [xz, yz, zz-e{k}] AS r{k}3" for k in (1, 3))
    crosses = ", ".join(f"{_cross(f'r{k}{i}', f'r{k}{j}')} AS {n}{k}" for k in (1, 3) for n, i, j in (("a", 1, 2), ("b", 1, 3), ("c", 2, 3)))
    return f""",
{out}_a AS (SELECT *, (xx+yy+zz)/3 AS q, sqrt((pow(xx-q,2)+pow(yy-q,2)+pow(zz-q,2)+2*(xy*xy+xz*xz+yz*yz))/6) AS p FROM {src}),
{out}_b AS (SELECT *, CASE WHEN p > 0 THEN ((xx-q)*(yy-q)*(zz-q)+2*xy*xz*yz-(xx-q)*yz*yz-(yy-q)*xz*xz-(zz-q)*xy*xy)/(2*p*p*p) ELSE 0 END AS r, acos(greatest(-1, least(1, r)))/3 AS phi, q+2*p*cos(phi) AS e1, q+2*p*cos(phi+2*pi()/3) AS e3, 3*q-e1-e3 AS e2,
  e1-e2 <= 1e-6*abs(e1) AS first, e2-e3 <= 1e-6*abs(e1) AS last FROM {out}_a),
{out}_c AS (SELECT *, {rows} FROM {out}_b), {out}_d AS (SELECT *, {crosses} FROM {out}_c), {out}_e AS (SELECT *, {best(1)} AS n1, {best(3)} AS n3 FROM {out}_d),
{out}_f AS (SELECT *, {_unit("n1")} AS w1, {_unit("n3")} AS w3 FROM {out}_e),
{out}_g AS (SELECT *, {_across("w1")} AS x1, {_across("w3")} AS x3 FROM {out}_f), {out}_h AS (SELECT *, {_unit("x1")} AS y1, {_unit("x3")} AS y3 FROM {out}_g),
{out}_i AS (SELECT *, CASE WHEN first AND last THEN [1.0::DOUBLE, 0, 0] WHEN first THEN y3 ELSE w1 END AS z1, CASE WHEN first AND last THEN [0.0::DOUBLE, 1, 0] WHEN last THEN y1 WHEN first THEN {_cross("w3", "y3")} ELSE {_cross("w3", "w1")} END AS z2 FROM {out}_h),
{out}_j AS (SELECT *, {_sided("z1", -1)} AS v1, {_sided("z2", 1)} AS v2 FROM {out}_i),
{out} AS (SELECT *, {_cross("v1", "v2")} AS v3 FROM {out}_j)"""


RANKED = FINAL + """,
rk AS (SELECT structure_id, comp, n, final_type AS type, (row_number() OVER (PARTITION BY structure_id, final_type ORDER BY n DESC, CASE type WHEN 'hub' THEN 0 WHEN 'pore' THEN 1 WHEN 'pocket' THEN 2 ELSE 3 END, comp) - 1)::INT AS id FROM fi WHERE n >= 4 AND final_type <> 'occluded')"""
#: Axial lengths, circularity and uniformity of each volume, and the slices they come from.
SHAPES = RANKED + """,
pt AS (SELECT cv.structure_id, comp, lx+(cv.vx+0.5)*0.04::DOUBLE AS x, ly+(cv.vy+0.5)*0.04::DOUBLE AS y, lz+(cv.vz+0.5)*0.04::DOUBLE AS z FROM cv JOIN rk USING (structure_id, comp) JOIN gr ON gr.structure_id=cv.structure_id),
me AS (SELECT structure_id, comp, avg(x) AS mx, avg(y) AS my, avg(z) AS mz FROM pt GROUP BY ALL),
sc AS (SELECT structure_id, comp, mx, my, mz, sum((x-mx)*(x-mx)) AS xx, sum((x-mx)*(y-my)) AS xy, sum((x-mx)*(z-mz)) AS xz, sum((y-my)*(y-my)) AS yy, sum((y-my)*(z-mz)) AS yz, sum((z-mz)*(z-mz)) AS zz FROM pt JOIN me USING (structure_id, comp) GROUP BY ALL)""" + axes_sql("sc", "ax") + """,
pj AS (SELECT structure_id, comp, list_inner_product(v1, [x-mx, y-my, z-mz]) AS a0, list_inner_product(v2, [x-mx, y-my, z-mz]) AS a1, list_inner_product(v3, [x-mx, y-my, z-mz]) AS a2 FROM pt JOIN ax USING (structure_id, comp)),
en AS (SELECT structure_id, comp, min(a0) AS low, max(a0) AS high, list_reverse_sort([round_even(max(a0)-min(a0),3), round_even(max(a1)-min(a1),3), round_even(max(a2)-min(a2),3)]) AS l FROM pj GROUP BY ALL),
sl AS (SELECT structure_id, comp, a1, a2, greatest(3, round_even((high-low)/0.04::DOUBLE, 0))::INT AS bins, least(bins-1, floor((a0-low)/(high-low)*bins+1e-9))::INT AS slice FROM pj JOIN en USING (structure_id, comp) WHERE high-low >= 1e-9),
ps AS (SELECT structure_id, comp, slice, count(*) AS c, (var_pop(a1)+var_pop(a2))/2 AS mid, sqrt(pow((var_pop(a1)-var_pop(a2))/2, 2)+pow(covar_pop(a1, a2), 2)) AS root FROM sl GROUP BY ALL),
sp AS (SELECT structure_id, comp, round_even(avg(CASE WHEN c >= 3 THEN CASE WHEN mid+root > 1e-12 THEN (mid-root)/(mid+root) ELSE 1 END END), 4)+0.0 AS circularity,
  CASE WHEN count(*) >= 2 THEN round_even(greatest(0, 1-stddev_pop(c)/avg(c)), 4) END AS uniformity FROM ps GROUP BY ALL)"""
VOLUME = repr(CFG.voxel_size**3)


@query(SHAPES + f""" SELECT structure_id, id, type, n*{VOLUME}::DOUBLE AS volume, l[1] AS x, l[2] AS y, l[3] AS z, CASE WHEN high-low < 1e-9 THEN 1 ELSE circularity END::DOUBLE AS circularity,
  CASE WHEN high-low < 1e-9 THEN 1 ELSE uniformity END::DOUBLE AS uniformity, n AS num_voxels, comp FROM rk JOIN en USING (structure_id, comp) LEFT JOIN sp USING (structure_id, comp)""")
def p02_annotate_volumes(spark, d):
    return annotate.annotate_volumes(views.v_points(spark, d), CFG)[0].select(*annotate.ROW)


@query(RANKED + " SELECT structure_id, " + ", ".join(f"coalesce(sum(n) FILTER (WHERE type='{k}'), 0)*{VOLUME}::DOUBLE AS {k}_total, coalesce(max(n) FILTER (WHERE type='{k}'), 0)*{VOLUME}::DOUBLE AS {k}_largest, count(*) FILTER (WHERE type='{k}') AS {k}_num" for k in ("cavity", "hub", "pocket", "pore")) + " FROM rk GROUP BY 1")
def a12_annotation_rollup(spark, d):
    return metrics.annotation_rollup(annotate.annotate_volumes(views.v_points(spark, d), CFG)[0])


@query(SHAPES + " SELECT structure_id, comp, slice, c AS num_voxels, bins AS num_slices FROM ps JOIN (SELECT DISTINCT structure_id, comp, bins FROM sl) USING (structure_id, comp)")
def w11_cross_sections(spark, d):
    """Voxels of each slice of each volume along its first principal axis."""
    annotations, shown = annotate.annotate_volumes(views.v_points(spark, d), CFG)
    grids = voxels.grid_bounds(views.v_points(spark, d), CFG.voxel_size)
    placed = metrics.component_centers(shown.select(*KEYS, "flat", "vx", "vy", "vz"), grids)
    sliced = metrics.slices(placed, grids, CFG.slice_width)
    return sliced.groupBy(*KEYS, "slice", "bins").agg(F.count(F.lit(1)).alias("num_voxels")).withColumnRenamed("bins", "num_slices")


def aligned_sql(src: str) -> str:
    """CTEs that end in ``al3``: the rows of ``src`` (structure_id, atom_seq, element, x, y, z)
    along the signed principal axes of their structures."""
    return f""",
me AS (SELECT structure_id, avg(x) AS mx, avg(y) AS my, avg(z) AS mz FROM {src} GROUP BY 1),
sc AS (SELECT structure_id, mx, my, mz, sum((x-mx)*(x-mx)) AS xx, sum((x-mx)*(y-my)) AS xy, sum((x-mx)*(z-mz)) AS xz, sum((y-my)*(y-my)) AS yy, sum((y-my)*(z-mz)) AS yz, sum((z-mz)*(z-mz)) AS zz FROM {src} JOIN me USING (structure_id) GROUP BY ALL)""" + axes_sql("sc", "ax") + f""",
pj AS (SELECT structure_id, atom_seq, element, list_inner_product(v1, [x-mx, y-my, z-mz]) AS a0, list_inner_product(v2, [x-mx, y-my, z-mz]) AS a1, list_inner_product(v3, [x-mx, y-my, z-mz]) AS a2 FROM {src} JOIN ax USING (structure_id)),
sg AS (SELECT structure_id, CASE WHEN sum(a0*a0*a0) < 0 THEN -1 ELSE 1 END AS s0, CASE WHEN sum(a2*a2*a2) < 0 THEN -1 ELSE 1 END AS s2 FROM pj GROUP BY 1),
al3 AS (SELECT structure_id, atom_seq, element, round(s0*a0, 5)+0.0 AS x, round(s0*s2*a1, 5)+0.0 AS y, round(s2*a2, 5)+0.0 AS z FROM pj JOIN sg USING (structure_id))"""


@query(ATOM_SQL + aligned_sql("a") + " SELECT structure_id, atom_seq, x, y, z FROM al3")
def g07_oriented_atoms(spark, d):
    """Every atom's place along the signed principal axes of its structure."""
    return prep.align(_atoms(spark, d)).select(SID, "atom_seq", *[(F.round(c, 5) + 0.0).alias(c) for c in "xyz"])


@query(ATOM_SQL + ", cl AS (SELECT * FROM a WHERE res_name IN ('ALA','GLY') AND element <> 'H' AND model = (SELECT min(model) FROM a b WHERE b.structure_id = a.structure_id))" + aligned_sql("cl") + " SELECT structure_id, element, x, y, z FROM al3")
def p01_prepared_points(spark, d):
    """Cleaned and aligned atoms, as the points of the voxel grid."""
    return prep.project_coords(prep.prepare(_atoms(spark, d), CFG)).select(SID, "element", *[(F.round(c, 5) + 0.0).alias(c) for c in "xyz"])


#: Radii of elements in the table, shells a voxel of 1 apart, and their numbers of points.
SHELL_POINTS = """WITH RECURSIVE p AS (SELECT label::BIGINT AS structure_id, ['C','N','O','S'][vec_id % 4 + 1] AS element, embedding[3*k+1]::DOUBLE AS x, embedding[3*k+2]::DOUBLE AS y, embedding[3*k+3]::DOUBLE AS z FROM embeddings, range(21) t(k)),
sr(element, r, k, full_r) AS (SELECT * FROM (VALUES ('C', 1.70::DOUBLE, 0, 1.70::DOUBLE), ('N', 1.55, 0, 1.55), ('O', 1.52, 0, 1.52), ('S', 1.80, 0, 1.80)) UNION ALL SELECT element, full_r - (k + 1), k + 1, full_r FROM sr WHERE r > 1),
ns(element, r, n) AS (SELECT element, r, 20 FROM sr UNION ALL SELECT element, r, 2 * n FROM ns
  WHERE r * sqrt(pow(sin(acos(1-1.0::DOUBLE/n)) - cos(pi()/((1+sqrt(5))/4))*sin(acos(1-3.0::DOUBLE/n)), 2) + pow(sin(pi()/((1+sqrt(5))/4))*sin(acos(1-3.0::DOUBLE/n)), 2) + pow(2.0::DOUBLE/n, 2)) > 1),
sn AS (SELECT element, r, max(n) AS n FROM ns GROUP BY ALL),
sp3 AS (SELECT element, cos(pi()*i/((1+sqrt(5))/4))*sin(acos(1-2*(i+0.5::DOUBLE)/n))*r AS dx, sin(pi()*i/((1+sqrt(5))/4))*sin(acos(1-2*(i+0.5::DOUBLE)/n))*r AS dy, (1-2*(i+0.5::DOUBLE)/n)*r AS dz FROM (SELECT *, unnest(range(n)) AS i FROM sn)),
ev AS (SELECT structure_id, element, x, y, z FROM p UNION ALL SELECT structure_id, element, x+dx, y+dy, z+dz FROM p JOIN sp3 USING (element))"""


@query(SHELL_POINTS + " SELECT structure_id, element, count(*) AS points, round(sum(x), 4) AS x, round(sum(y), 4) AS y, round(sum(z), 4) AS z, round(min(x), 6) AS low, round(max(z), 6) AS high FROM ev GROUP BY ALL")
def j02_shell_points(spark, d):
    """Points with those on the shells around them: their number, sums and ends."""
    every = prep.expand_shells(views.v_points(spark, d), 1.0)
    return every.groupBy(SID, "element").agg(F.count(F.lit(1)).alias("points"), *[F.round(F.sum(c), 4).alias(c) for c in "xyz"], F.round(F.min("x"), 6).alias("low"), F.round(F.max("z"), 6).alias("high"))


@query(RANKED + """, su2 AS (SELECT structure_id, comp, mouth FROM fl JOIN fi USING (structure_id, comp) WHERE final_type = 'cavity' OR (type = 'pore' AND narrow AND (SELECT count(*) FROM fl f2 WHERE f2.structure_id=fl.structure_id AND f2.comp=fl.comp) >= 2)),
sv AS (SELECT DISTINCT ef.structure_id, ef.comp, ef.flat FROM ef JOIN fi ON fi.structure_id=ef.structure_id AND fi.comp=ef.comp AND final_type <> 'occluded' ANTI JOIN su2 ON su2.structure_id=ef.structure_id AND su2.comp=ef.comp AND su2.mouth=ef.mouth)
SELECT cv.structure_id, CASE type WHEN 'hub' THEN 'HUB' WHEN 'pore' THEN 'POR' WHEN 'pocket' THEN 'POK' ELSE 'CAV' END AS res_name, id AS res_id, CASE type WHEN 'hub' THEN 'A' WHEN 'pore' THEN 'B' WHEN 'pocket' THEN 'C' ELSE 'D' END AS chain_id,
  CASE type WHEN 'hub' THEN 'F' WHEN 'pore' THEN 'O' WHEN 'pocket' THEN 'N' ELSE 'S' END AS element, cv.flat, round(lx+(cv.vx+0.5)*0.04::DOUBLE, 6) AS x, round(ly+(cv.vy+0.5)*0.04::DOUBLE, 6) AS y, round(lz+(cv.vz+0.5)*0.04::DOUBLE, 6) AS z, CASE WHEN sv.flat IS NOT NULL THEN 50 ELSE 0 END::DOUBLE AS b_factor
FROM rk JOIN cv USING (structure_id, comp) JOIN gr ON gr.structure_id=cv.structure_id LEFT JOIN sv ON sv.structure_id=cv.structure_id AND sv.flat=cv.flat""")
def x34_volume_records(spark, d):
    """The records that stand for the voxels of volumes in written structures."""
    points = views.v_points(spark, d)
    found = annotate.pseudo_atoms(*annotate.annotate_volumes(points, CFG), voxels.grid_bounds(points, CFG.voxel_size))
    return found.select(SID, "res_name", "res_id", "chain_id", "element", "flat", *[F.round(c, 6).alias(c) for c in "xyz"], "b_factor")
