"""Tokens to lines: clusters on a baseline, their text, hyphens at line ends."""

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .. import constants as K
from ..sources.tables import page_tokens
from .perpage import per_page

LINE = "line int, text string, cross double, min_x double, min_y double, max_x double, max_y double, font_key string, tokens int, runs int"
#: Pairs that are looked at together.
CHUNK = 1 << 20


class _Classes:
    """Numbers from 0 to n - 1 in classes, each named by its least."""

    def __init__(self, n: int):
        self.root = list(range(n))

    def find(self, i: int) -> int:
        root = self.root
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    def join(self, a: int, b: int) -> None:
        a, b = self.find(a), self.find(b)
        if a != b:
            self.root[max(a, b)] = min(a, b)


def _chunks(sizes: np.ndarray, most: int):
    """Ranges (a, z) of consecutive items whose sizes add up to `most` at most; an item above it is alone."""
    total, a = np.cumsum(sizes), 0
    while a < len(sizes):
        z = max(a + 1, int(np.searchsorted(total, most + (total[a - 1] if a else 0), side="right")))
        yield a, z
        a = z


def _labels(cross: np.ndarray, size: np.ndarray, along: np.ndarray, end: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Of each token the least token of its line.

    Two tokens are linked on one baseline with a gap of at most a character's size or white space between, or if one is much smaller beside a larger.
    Tokens of one cross and size that each link to the one before them are a chain, and only links between chains are looked for one by one:
    work grows with the tokens where the chains are whole, and memory always does.
    """
    n = len(cross)
    order = np.lexsort((along, size, cross))  # ties stay in order of idx
    c, s, a, e, f, z = (x[order] for x in (cross, size, along, end, first, last))
    same = (c[1:] == c[:-1]) & (s[1:] == s[:-1])
    near = (a[1:] - e[:-1] <= s[1:] * K.TRACKING_RATIO) | (f[1:] > z[:-1])
    chain_at, group_at = (np.concatenate([[0], np.flatnonzero(~x) + 1]) for x in (same & near, same))
    chain = np.repeat(np.arange(len(chain_at)), np.diff(np.append(chain_at, n)))
    ends, heads = np.append(group_at, n), np.append(chain[group_at], len(chain_at))  # of each group its first token and chain
    classes = _Classes(len(chain_at))

    if len(chain_at) > len(group_at):  # chains of one group: the later one's nearest token to the earlier one's farthest
        far, most, least = np.maximum.reduceat(e, chain_at), np.maximum.reduceat(f, chain_at), np.minimum.reduceat(z, chain_at)
        for g in np.flatnonzero(np.diff(heads) > 1).tolist():
            p, q = int(heads[g]), int(heads[g + 1])
            label = np.arange(p, q)
            for k in range(p + 1, q):
                hit = (a[chain_at[k]] - far[p:k] <= s[group_at[g]] * K.TRACKING_RATIO) | (most[k] > least[p:k])
                found = np.unique(label[: k - p][hit])
                if len(found):
                    label[: k - p][np.isin(label[: k - p], found)] = found[0]
                    label[k - p] = found[0]
            for k, x in enumerate(label.tolist(), p):
                classes.join(k, x)

    gc, gs = c[group_at], s[group_at]
    ahead = np.searchsorted(gc, gc + max(K.LINE_HEIGHT_RATIO * gs.max(), 1.0), side="right") - np.arange(len(gc)) - 1
    for lo, hi in _chunks(ahead, CHUNK):
        i = np.repeat(np.arange(lo, hi), ahead[lo:hi])
        j = i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(ahead[lo:hi]) - ahead[lo:hi], ahead[lo:hi])
        big, small, off = np.maximum(gs[i], gs[j]), np.minimum(gs[i], gs[j]), gc[j] - gc[i]
        level = off <= np.maximum(1.0, big * K.BASELINE_RATIO)
        beside = ~level & (small / big <= K.SUBSCRIPT_RATIO) & (off < big * K.LINE_HEIGHT_RATIO)
        for g, h in zip(i[beside].tolist(), j[beside].tolist(), strict=True):  # all tokens of both are one
            for k in (*range(heads[g], heads[g + 1]), *range(heads[h], heads[h + 1])):
                classes.join(int(heads[g]), k)
        i, j = i[level], j[level]
        for g in np.unique(i).tolist():
            others = j[np.searchsorted(i, g) : np.searchsorted(i, g, side="right")].tolist()
            if len({classes.find(k) for x in (g, *others) for k in range(heads[x], heads[x + 1])}) == 1:
                continue
            here, there = np.arange(ends[g], ends[g + 1]), np.concatenate([np.arange(ends[h], ends[h + 1]) for h in others])
            for k in range(0, len(here), width := max(1, CHUNK // len(there))):
                x = here[k : k + width, None]
                before = (a[x] < a[there]) | ((a[x] == a[there]) & ((c[x] < c[there]) | (order[x] < order[there])))
                gap = np.where(before, a[there] - e[x], a[x] - e[there])
                white = np.where(before, f[there] > z[x], f[x] > z[there])
                u, v = np.nonzero((gap <= np.maximum(s[x], s[there]) * K.TRACKING_RATIO) | white)
                for pair in np.unique(chain[x[u, 0]] * len(chain_at) + chain[there[v]]).tolist():
                    classes.join(*divmod(pair, len(chain_at)))
    line = np.fromiter(map(classes.find, range(len(chain_at))), np.int64, len(chain_at))[chain]
    least = np.full(len(chain_at), n)
    np.minimum.at(least, line, order)
    out = np.empty(n, dtype=np.int64)
    out[order] = least[line]
    return out


def _page_lines(t: dict, sign: int, join_hyphens: bool) -> list[list]:
    """LINE of a page's tokens, given as columns in order of idx; see cluster_lines."""
    text_of, fonts = t["str"], t["font_key"]
    if not len(text_of):
        return []
    along, cross, size, width, height, first, last = (np.asarray(t[c]) for c in ("along", "cross", "size", "width", "height", "breaks", "last_breaks"))
    end = along + width
    label = _labels(cross, size, along, end, first, last)
    order = np.lexsort((along, label))  # ties stay in order of idx
    code = {k: n for n, k in enumerate(dict.fromkeys(fonts))}
    label, code = label[order], np.fromiter(map(code.__getitem__, fonts), np.int64, len(fonts))[order]
    new = np.concatenate([[True], label[1:] != label[:-1]])
    blank = np.concatenate([[False], first[order][1:] > last[order][:-1]]) & ~new
    turn = new | np.concatenate([[True], code[1:] != code[:-1]])
    start = np.flatnonzero(new)
    stop = np.append(start[1:], len(order))
    blanks, runs = np.add.reduceat(blank.astype(np.int64), start).tolist(), np.add.reduceat(turn.astype(np.int64), start).tolist()
    low, high, right = np.minimum.reduceat(cross[order], start).tolist(), np.maximum.reduceat((cross + height)[order], start).tolist(), np.maximum.reduceat(end[order], start).tolist()
    left, rows, lines = along[order[start]].tolist(), order.tolist(), []
    for n, (p, q) in enumerate(zip(start.tolist(), stop.tolist(), strict=True)):
        own = rows[p:q]
        words = [text_of[k] for k in own]
        text = " ".join(words) if blanks[n] == q - p - 1 else "".join(" " + x if b else x for x, b in zip(words, blank[p:q].tolist(), strict=True))
        head = own[0]
        if runs[n] > 1:
            chars: dict = {}
            for k, x in zip(own, words, strict=True):
                chars[fonts[k]] = chars.get(fonts[k], 0) + len(x)
            font = max(chars, key=chars.get)  # the first of equal ones
            head = next(k for k in own if fonts[k] == font)
        lines.append([0, text, float(cross[head]), left[n], low[n], right[n], high[n], fonts[head], q - p, runs[n]])
    lines.sort(key=lambda x: sign * x[2])
    return joined(lines) if join_hyphens else lines


def _schema(rows: DataFrame, page: list[str]) -> StructType:
    return StructType([rows.schema[c] for c in page] + StructType.fromDDL(LINE).fields)


def cluster_lines(tokens: DataFrame, page: list[str], *, sign: int = -1, join_hyphens: bool = True) -> DataFrame:
    """The page's columns and LINE: tokens of one angle as lines, numbered from the top (sign -1) or by rising cross (1).

    tokens: the page's columns, idx, str, along, cross, size, width, height, font_key, breaks and last_breaks (white
    space before the token's first and last item). Connected tokens are a line, as the relation isn't transitive. Its
    text has a blank where white space is between neighbours. The font is that of most characters, the first on a tie;
    cross is that of its first token. A line that ends with a hyphen takes the first word of one that begins with a small letter.
    """

    def work(t: dict[str, list]) -> list[tuple]:
        where = tuple(t[c][0] for c in page)
        return [(*where, k, *x[1:]) for k, x in enumerate(_page_lines(t, sign, join_hyphens))]

    return per_page(tokens, page, ["idx"], _schema(tokens, page), work)


def cluster_text(rows: DataFrame, page: list[str], *, join_hyphens: bool = True) -> DataFrame:
    """What cluster_lines makes of the words that lines of plain text emit (rows: the page's columns, line_no, line).

    The lines go through the shuffle as they are; words are made of them and put in lines in one task.
    """

    def work(t: dict[str, list]) -> list[tuple]:
        where = tuple(t[c][0] for c in page)
        return [(*where, k, *x[1:]) for k, x in enumerate(_page_lines(page_tokens(t["line_no"], t["line"]), -1, join_hyphens))]

    return per_page(rows, page, ["line_no"], _schema(rows, page), work)


def joined(lines: list[list]) -> list[list]:
    """Lines (number, text, cross, box, font, tokens, runs) with words joined that a hyphen at a line's end parts; a joined line is the next one's neighbour."""
    out: list[list] = []
    for line in lines:
        if out and out[-1][1].endswith("-") and line[1][:1].islower():
            prev = out[-1]
            word, *rest = line[1].split(maxsplit=1)
            prev[1] = prev[1][:-1] + word
            prev[3:7] = [min(prev[3], line[3]), min(prev[4], line[4]), max(prev[5], line[5]), max(prev[6], line[6])]
            prev[8], prev[9] = prev[8] + line[8], prev[9] + line[9]
            if rest:
                out.append([line[0], rest[0], *line[2:]])
            continue
        out.append(list(line))
    return out


def split_edges(runs: DataFrame, line: list[str]) -> DataFrame:
    """The line's columns, part (from 0), text, font_key, runs: a line's runs (run, font_key, text, in order of run) with those at its edges apart that aren't in its commonest font.

    The font of most characters is the commonest, the first on a tie. Runs before its first one are each a part if they have fewer characters than the
    rest; so are those behind its last one. What lies between stays together. Lines of one font are one part.
    """
    whole, order = Window.partitionBy(*line), Window.partitionBy(*line).orderBy("run")
    x = runs.withColumn("_n", F.length("text")).withColumn("_sum", F.sum("_n").over(Window.partitionBy(*line, "font_key"))).withColumn("_at", F.min("run").over(Window.partitionBy(*line, "font_key")))
    best = F.max(F.struct("_sum", (-F.col("_at")).alias("a"), "font_key")).over(whole)["font_key"]
    x = x.withColumn("_best", best).withColumn("_total", F.sum("_n").over(whole))
    main = F.when(F.col("font_key") == F.col("_best"), F.col("run"))
    x = x.withColumn("_a", F.min(main).over(whole)).withColumn("_z", F.max(main).over(whole))
    x = x.withColumn("_head", F.sum(F.when(F.col("run") < F.col("_a"), F.col("_n")).otherwise(0)).over(whole)).withColumn("_tail", F.sum(F.when(F.col("run") > F.col("_z"), F.col("_n")).otherwise(0)).over(whole))
    head = (F.col("run") < F.col("_a")) & (F.col("_head") < F.col("_total") - F.col("_head"))
    tail = (F.col("run") > F.col("_z")) & (F.col("_tail") < F.col("_total") - F.col("_tail"))
    x = x.withColumn("_alone", head | tail)
    x = x.withColumn("_new", (F.col("_alone") | F.coalesce(F.lag("_alone").over(order), F.lit(True))).cast("int"))
    x = x.withColumn("part", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)) - 1)
    parts = x.groupBy(*line, "part").agg(F.array_sort(F.collect_list(F.struct("run", "text"))).alias("_t"), F.count("*").alias("runs"), F.max(F.struct("_sum", (-F.col("_at")).alias("a"), "font_key"))["font_key"].alias("font_key"))
    return parts.select(*line, "part", F.array_join(F.transform("_t", lambda t: t["text"]), "").alias("text"), "font_key", "runs")


def repair_gutters(lines: DataFrame, gutters: DataFrame, page: list[str], least: float = 0.85) -> DataFrame:
    """lines (the page's columns, line, min_x, max_x, tokens: array of text, min_x, max_x) parted where they cross gutters (the page's columns, confidence, all: array of
    min_x, max_x): fragment (from 0; null: left whole), text, min_x, max_x.

    A line is parted if the columns are sure enough, none of its tokens reaches into a gutter that it crosses, and every part has a token.
    """
    x = lines.join(gutters, page, "left")
    crossed = F.when(F.col("confidence") >= least, F.filter("all", lambda g: (F.col("min_x") < g["min_x"]) & (F.col("max_x") > g["max_x"])))
    x = x.withColumn("_g", F.coalesce(crossed, F.array().cast("array<struct<min_x:double,max_x:double>>")))
    free = ~F.exists("_g", lambda g: F.exists("tokens", lambda t: (t["max_x"] > g["min_x"]) & (t["min_x"] < g["max_x"])))
    place = lambda t: F.size(F.filter(F.col("_g"), lambda g: g["max_x"] <= t["min_x"]))
    x = x.withColumn("_p", F.transform("tokens", lambda t: place(t)))
    ok = (F.size("_g") > 0) & free & (F.size(F.array_distinct("_p")) == F.size("_g") + 1)
    x = x.withColumn("fragment", F.explode(F.when(ok, F.sequence(F.lit(0), F.size("_g"))).otherwise(F.array(F.lit(None).cast("int")))))
    own = F.filter("tokens", lambda t: F.col("fragment").isNull() | (place(t) == F.col("fragment")))
    x = x.withColumn("tokens", own)
    return x.select(*page, "line", "fragment", F.array_join(F.transform("tokens", lambda t: t["text"]), " ").alias("text"), F.array_min(F.transform("tokens", lambda t: t["min_x"])).alias("min_x"), F.array_max(F.transform("tokens", lambda t: t["max_x"])).alias("max_x"))


def gutter_crossings(repaired: DataFrame, gutters: DataFrame, page: list[str]) -> DataFrame:
    """The page's columns and crossing: lines that still cross a gutter of sure columns with no token in it."""
    x = repaired.join(gutters, page)
    return x.groupBy(*page).agg(F.count_if(F.exists("all", lambda g: (F.col("min_x") < g["min_x"]) & (F.col("max_x") > g["max_x"]))).alias("crossing"))
