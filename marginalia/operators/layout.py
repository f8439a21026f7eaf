"""Figures and captions of scanned pages, by their boxes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BAND = 40.0
ABOVE, BELOW = -10.0, 80.0


def envelope(polygon: Column) -> Column:
    """[x0, y0, x1, y1] of a box or polygon given as x, y, x, y…; null for fewer than four numbers."""
    xs = F.filter(polygon, lambda _, i: i % 2 == 0)
    ys = F.filter(polygon, lambda _, i: i % 2 == 1)
    return F.when(F.size(polygon) >= 4, F.array(F.array_min(xs), F.array_min(ys), F.array_max(xs), F.array_max(ys)))


def to_points(box: Column, width: Column, height: Column) -> Column:
    """A box on the 0–1000 grid in points of the page."""
    return F.array(box[0] * width / 1000, box[1] * height / 1000, box[2] * width / 1000, box[3] * height / 1000)


def field(region: Column, *names: str) -> Column:
    """The first of several keys that holds something."""
    return F.coalesce(*[F.nullif(F.trim(region.getItem(n)), F.lit("")) for n in names])


def region_type(region: Column) -> Column:
    return F.lower(F.trim(field(region, "native_label", "label", "type")))


def region_text(region: Column) -> Column:
    return field(region, "content", "text", "markdown")


def region_image(region: Column) -> Column:
    """The path of a region's image, where the recogniser cut one out."""
    return field(region, "image_path", "img_path", "image")


def _boxed(boxes: DataFrame, i: str, ordinal: Column, name: str) -> DataFrame:
    """(page_id, `name`): the boxes of each page in one list."""
    x = F.struct(F.col(i).cast("long").alias("id"), ordinal.cast("long").alias("ordinal"), *[F.col("box")[k].cast("double").alias(n) for k, n in enumerate(("x0", "y0", "x1", "y1"))])
    return boxes.where("box is not null").select("page_id", x.alias("x")).groupBy("page_id").agg(F.collect_list("x").alias(name))


def _flat(lists: pa.Array) -> tuple[np.ndarray, dict[str, np.ndarray], pa.Array]:
    """Of lists of boxes: the list that each box is in, what it holds, and its id, which may be null."""
    x = lists.flatten()
    of = np.repeat(np.arange(len(lists)), np.asarray(pc.fill_null(pc.list_value_length(lists), 0), dtype=np.int64))
    names, parts = [f.name for f in x.type], dict(zip([f.name for f in x.type], x.flatten()))
    held = {n: parts[n].cast(pa.float64()).to_numpy(zero_copy_only=False) for n in names[2:]}  # a number missing is NaN
    for n in names[:2]:
        held[n], held[f"no {n}"] = np.asarray(parts[n].fill_null(0)), np.asarray(parts[n].is_null())
    return of, held, parts["id"]


def _in_order(of: np.ndarray, *keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The boxes by page and keys, and where each page that has any begins and how many it has."""
    order = np.lexsort((*reversed(keys), of))
    starts = np.flatnonzero(np.diff(of[order], prepend=-1))
    return order, starts, np.diff(starts, append=len(of))


def _labels(top: np.ndarray, bottom: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Clusters of figures in order, page after page. Step k takes the figure k of all pages that have so many."""
    pages = np.argsort(-sizes, kind="stable")
    starts, sizes = starts[pages], sizes[pages]
    label = np.zeros(len(top), dtype=np.int32)
    lo, hi = np.full((len(pages), 1), np.inf), np.full((len(pages), 1), -np.inf)  # bands that no page has yet meet nothing
    made = np.zeros(len(pages), dtype=np.int64)
    for k in range(sizes[0] if len(sizes) else 0):
        n = int(np.searchsorted(-sizes, -k))  # pages of more than k figures
        lo, hi, made = lo[:n], hi[:n], made[:n]
        if made.max() == lo.shape[1]:
            lo, hi = (np.concatenate([x, np.full(x.shape, fill)], axis=1) for x, fill in ((lo, np.inf), (hi, -np.inf)))
        t, b, row = top[starts[:n] + k], bottom[starts[:n] + k], np.arange(n)
        meets = (t[:, None] < hi + BAND) & (b[:, None] > lo - BAND)
        at = meets.argmax(axis=1)
        new = ~meets[row, at]
        at = np.where(new, made, at)
        lo[row, at] = np.where(new, t, np.minimum(lo[row, at], t))
        hi[row, at] = np.where(new, b, np.maximum(hi[row, at], b))
        made = made + new
        label[starts[:n] + k] = at
    return label


def cluster_figures(figures: DataFrame) -> DataFrame:
    """Adds `cluster`: figures of a page by rows. In order of (y, x) a figure joins the first
    cluster whose band, widened by `BAND`, meets its own; clusters grow with their figures.

    `figures`: page_id, fig_id, box. The order matters, so a page is taken whole by a task; the pages
    of an Arrow batch are worked through side by side.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            of, x, ids = _flat(batch.column("figs"))
            order, starts, sizes = _in_order(of, x["y0"], x["x0"], x["no id"], x["id"])
            label = _labels(x["y0"][order], x["y1"][order], starts, sizes)
            yield pa.RecordBatch.from_arrays([batch.column("page_id").cast(pa.int64()).take(pa.array(of[order])), ids.take(pa.array(order)), pa.array(label)], ["page_id", "fig_id", "cluster"])

    return _boxed(figures, "fig_id", F.lit(None), "figs").mapInArrow(run, "page_id long, fig_id long, cluster int")


def _choices(f: dict[str, np.ndarray], figs: tuple[np.ndarray, np.ndarray, np.ndarray], c: dict[str, np.ndarray], caps: tuple[np.ndarray, np.ndarray, np.ndarray]) -> np.ndarray:
    """For each figure, page after page, the place of its caption or -1. `figs` and `caps`: page of each, and start and
    size of each page, in order, with size 0 for a page that has none. Step k takes the figure k of all pages."""
    (_, f_start, f_size), (_, c_start, c_size) = figs, caps
    chosen = np.full(len(f["y1"]), -1, dtype=np.int64)
    left = np.ones(len(c["y0"]), dtype=bool)
    for k in range(f_size.max(initial=0)):
        pages = np.flatnonzero((f_size > k) & (c_size > 0))
        if not len(pages):
            break
        n = c_size[pages]
        begins = np.cumsum(n) - n
        cap = np.repeat(c_start[pages] - begins, n) + np.arange(int(n.sum()))
        fig = np.repeat(f_start[pages] + k, n)
        gap = c["y0"][cap] - f["y1"][fig]
        ok = left[cap] & (np.fmin(f["x1"][fig], c["x1"][cap]) - np.fmax(f["x0"][fig], c["x0"][cap]) > 0) & (gap >= ABOVE)
        gap = np.where(ok, gap, np.inf)
        best = np.flatnonzero(ok & (gap == np.repeat(np.minimum.reduceat(gap, begins), n)))
        best = best[np.diff(fig[best], prepend=-1) > 0]  # of equally near ones the first
        chosen[fig[best]] = cap[best]
        left[cap[best]] = False
    return chosen


def pair_captions(figures: DataFrame, captions: DataFrame) -> DataFrame:
    """(page_id, fig_id, cap_id): each figure's nearest caption below that shares its columns, each
    caption once, null where none is left. Figures choose in reading order, which is their `ordinal` (else
    their id): figures of one row may differ by a point in height, so boxes don't tell it.

    Figures and captions are gathered apart and joined by page, so inputs that lie by page aren't shuffled again.
    """
    order = lambda df, i: F.col("ordinal") if "ordinal" in df.columns else F.col(i)
    f, c = figures.where("fig_id is not null"), captions.where("cap_id is not null")
    figs, caps = _boxed(f, "fig_id", order(figures, "fig_id"), "figs"), _boxed(c, "cap_id", order(captions, "cap_id"), "caps")
    unpaged = figs.where("page_id is null").withColumn("caps", F.lit(None).cast(caps.schema["caps"].dataType)).unionByName(caps.where("page_id is null").withColumn("figs", F.lit(None).cast(figs.schema["figs"].dataType)))
    unpaged = unpaged.groupBy("page_id").agg(F.first("figs", True).alias("figs"), F.first("caps", True).alias("caps"))  # boxes without a page are one page, which a join would part
    pages = figs.where("page_id is not null").join(caps, "page_id", "left").unionByName(unpaged)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held, places, ids = [], [], []
            for name in ("figs", "caps"):
                of, x, i = _flat(batch.column(name))
                by, starts, sizes = _in_order(of, x["no ordinal"], x["ordinal"], x["id"])
                start, size = np.zeros((2, batch.num_rows), dtype=np.int64)
                start[of[by][starts]], size[of[by][starts]] = starts, sizes
                held.append({n: v[by] for n, v in x.items()})
                places.append((of[by], start, size))
                ids.append(i.take(pa.array(by)))
            chosen = _choices(held[0], places[0], held[1], places[1])
            cap = ids[1].take(pa.array(chosen, mask=chosen < 0))
            yield pa.RecordBatch.from_arrays([batch.column("page_id").cast(pa.int64()).take(pa.array(places[0][0])), ids[0], cap], ["page_id", "fig_id", "cap_id"])

    return pages.mapInArrow(run, "page_id long, fig_id long, cap_id long")


def captions_in_band(clusters: DataFrame, captions: DataFrame) -> DataFrame:
    """(page_id, cluster, cap_id): captions from a little above a cluster's head to some way below its foot."""
    j = clusters.select("page_id", "cluster", "top", "bottom").join(captions.select("page_id", "cap_id", F.col("box")[1].alias("y")), "page_id")
    return j.where(F.col("y").between(F.col("top") + ABOVE, F.col("bottom") + BELOW)).select("page_id", "cluster", "cap_id")


def nearest_figure_above(captions: DataFrame, figures: DataFrame) -> DataFrame:
    """(page_id, cap_id, box): from the nearest figure above to the caption; else the caption padded."""
    c = captions.select("page_id", "cap_id", F.col("box").alias("cb"))
    f = figures.select("page_id", F.col("box").alias("fb"))
    gap = F.col("cb")[1] - F.col("fb")[3]
    best = c.join(f, "page_id").where(gap >= ABOVE).groupBy("page_id", "cap_id").agg(F.min_by("fb", F.struct(gap, "fb")).alias("fb"))
    j = c.join(best, ["page_id", "cap_id"], "left")
    lo = lambda i: F.least(F.col("fb")[i], F.col("cb")[i])
    hi = lambda i: F.greatest(F.col("fb")[i], F.col("cb")[i])
    padded = F.array(F.col("cb")[0], F.greatest(F.lit(0.0), F.col("cb")[1] - 30), F.col("cb")[2], F.col("cb")[3] + 15)
    return j.select("page_id", "cap_id", F.when(F.col("fb").isNotNull(), F.array(lo(0), lo(1), hi(2), hi(3))).otherwise(padded).alias("box"))


# fixed values: how captions open
CAPTION = r"(?i)^\s*(figure|table|tableau)\s+[.\dIVX]"
TABLE_CAPTION = r"(?i)^\s*(table|tableau)\s+[.\dIVX]"
SUB_CAPTION = r"(?i)^\s*\([a-z]\)"


def is_composite(captions: Column) -> Column:
    """Whether a plate has several lettered parts, which are described one by one."""
    return F.size(F.filter(F.coalesce(captions, F.array().cast("array<string>")), lambda x: x.rlike(SUB_CAPTION))) >= 2


def route(captions: Column) -> Column:
    """`composite` for a plate whose parts are described one by one, else `simple`."""
    return F.when(is_composite(captions), "composite").otherwise("simple")


def padded(box: Column, width: Column, height: Column, by: float = 8.0) -> Column:
    """A box with a margin on all sides, within its page."""
    return F.array(F.greatest(F.lit(0.0), box[0] - by), F.greatest(F.lit(0.0), box[1] - by), F.least(width, box[2] + by), F.least(height, box[3] + by))


def caption_lines(text: Column) -> Column:
    """A page's lines that caption a figure, not a table."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: x.rlike(CAPTION) & ~x.rlike(TABLE_CAPTION))


def _bare(line: Column) -> Column:
    return F.regexp_replace(F.lower(line), r"[^\p{L}\p{N}]+", "")


def find_line(lines: Column, wanted: Column) -> Column:
    """1-based place of the line that equals the wanted one but for marks, else that holds it or is held; 0 for none."""
    w = _bare(wanted)
    exact = F.array_position(F.transform(lines, _bare), w)
    loose = F.array_position(F.transform(lines, lambda x: (_bare(x) != "") & (w != "") & (F.contains(_bare(x), w) | F.contains(w, _bare(x)))), F.lit(True))
    return F.when(F.coalesce(w, F.lit("")) == "", F.lit(0)).when(exact > 0, exact).otherwise(loose).cast("int")


def insert_figure(text: Column, caption: Column, block: Column) -> Column:
    """The figure's block in place of its caption line, else before the page."""
    lines = F.split(text, "\n")
    at = find_line(lines, caption)
    put = F.array_join(F.transform(lines, lambda x, i: F.when(i + 1 == at, block).otherwise(x)), "\n")
    return F.when(at > 0, put).otherwise(F.concat(block, F.lit("\n\n"), text))


def figure_block(caption: Column, description: Column) -> Column:
    return F.concat(F.lit("--- [FIGURE] ---\n"), F.array_join(F.filter(F.array(caption, description), lambda x: F.coalesce(x, F.lit("")) != ""), "\n"), F.lit("\n--- [/FIGURE] ---"))


def assemble(pages: DataFrame) -> DataFrame:
    """(source_id, markdown): a document's pages in order, each after its mark."""
    block = F.concat(F.lit("<!-- loc page="), F.col("page").cast("string"), F.lit(" -->\n\n"), F.trim(F.coalesce("text", F.lit(""))))
    ordered = F.array_sort(F.collect_list(F.struct("page", block.alias("b"))))
    return pages.groupBy("source_id").agg(F.array_join(F.transform(ordered, lambda x: x["b"]), "\n\n").alias("markdown"))


def clean_caption(raw: Column) -> Column:
    """Recognised text up to the first fence, without lines that repeat or begin the kept line before."""
    lines = F.filter(F.transform(F.split(F.split(F.coalesce(raw, F.lit("")), "```")[0], "\n"), F.trim), lambda x: x != "")
    start = F.array().cast("array<string>")

    def step(kept: Column, line: Column) -> Column:
        last = F.coalesce(F.try_element_at(kept, F.lit(-1)), F.lit(""))
        return F.when((F.size(kept) > 0) & last.startswith(line), kept).otherwise(F.array_append(kept, line))

    return F.array_join(F.aggregate(lines, start, step), "\n")


def match_by_order(clusters: DataFrame, captions: DataFrame) -> DataFrame:
    """Captions of a page to its clusters by position: (page_id, cluster, caption)."""
    a = clusters.withColumn("_o", F.row_number().over(Window.partitionBy("page_id").orderBy("cluster")))
    b = captions.withColumn("_o", F.row_number().over(Window.partitionBy("page_id").orderBy("position")))
    return a.join(b.select("page_id", "_o", "caption"), ["page_id", "_o"], "left").select("page_id", "cluster", "caption")
