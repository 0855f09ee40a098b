"""Ancestry of what is asked for: histories cut into runs, frontiers of questions over them, topological levels, cycles, and interval labels of trees.

The closure of a history grows with the square of its length, so nothing here closes one.  A history is first cut into *runs*, longest ways on which every
revision but the last has one parent and every one but the first has one child.  The place of each revision in its run is found by pointer jumping, in
as many rounds as the logarithm of the longest run.  A run is entered at its first revision alone, or where a question begins in it, so that a question about a
revision is a table of entries, one for each run that it goes through, however long the runs are.  Rounds over entries are as many as the most runs on a way.

All tables between rounds are in the shared folder and are removed when the answer is written.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rolewise.operators.facts import following
from rolewise.sources.tables import discard, durable

class Grown:
    """A relation that rounds add rows to, every row once.  However many rounds there were, it is read by one scan, so plans don't grow with them."""

    def __init__(self, name: str):
        self.name, self.parts, self.paths = name, [], []

    def add(self, df: DataFrame) -> DataFrame:
        """Writes ``df`` as the relation's next part."""
        part = durable(df, self.name)
        self.parts.append(part)
        self.paths += sorted({file.rsplit("/", 1)[0] for file in part.inputFiles()})
        return part

    @property
    def all(self) -> DataFrame:
        first = self.parts[0]
        return first.sparkSession.read.schema(first.schema).parquet(*self.paths) if self.paths else first

    def drop(self) -> None:
        discard(*self.parts)


def ranked(pointers: DataFrame) -> tuple[DataFrame, DataFrame]:
    """For ``pointers(node, next)``, in which nothing is pointed to twice: ``node, last, steps``, where each chain ends and how far that is, and ``node, least`` of rings.

    Every round doubles how far a pointer leads, and what has reached an end isn't written again.  What has reached none when pointers lead further than
    there are nodes is on a ring, which is named by its least node.  Both tables are the caller's to discard.
    """
    ended = F.col("next").isNull()
    state = Grown("ranked")
    last = state.add(pointers.select("node", F.coalesce("next", "node").alias("to"), F.when(ended, 0).otherwise(1).cast("bigint").alias("steps"), F.least("node", "next").alias("least"), ended.alias("ended")))
    n, span = last.count(), 1
    while span < n and not last.where("NOT ended").isEmpty():
        further = state.all.where("ended").unionByName(last.where("NOT ended"))
        further = further.select(F.col("node").alias("at"), F.col("to").alias("on"), F.col("steps").alias("more"), F.col("least").alias("low"), F.col("ended").alias("there"))
        met = last.where("NOT ended").join(further, F.col("to") == F.col("at"))
        last = state.add(met.select("node", F.col("on").alias("to"), (F.col("steps") + F.col("more")).alias("steps"), F.least("least", "low").alias("least"), F.col("there").alias("ended")))
        span *= 2
    found = durable(state.all.where("ended").select("node", F.col("to").alias("last"), "steps"), "ranked-ends")
    rings = durable(last.where("NOT ended").select("node", "least"), "ranked-rings")
    state.drop()
    return found, rings


@dataclass
class Runs:
    """``members(node, run, offset)``: a run is named by its last node, and an offset is how far before that a node is.  ``links(run, to_run, to_offset)`` lead from a run's last
    node to the first ones of others; a ring of single links is a run that leads to itself."""

    members: DataFrame
    links: DataFrame

    def drop(self) -> None:
        discard(self.members, self.links)


def runs(edges: DataFrame) -> Runs:
    """The runs of ``edges(src, dst)``; rows with a null ``dst`` give a node without a link, repeated rows count once."""
    given = durable(edges.select("src", "dst").where("src IS NOT NULL").distinct(), "runs-edges")
    links = given.where("dst IS NOT NULL")
    nodes = given.select(F.col("src").alias("node")).union(links.select("dst")).distinct()
    single = [links.groupBy(F.col(c).alias(f"_{c}")).agg(F.count(F.lit(1)).alias("n")).where("n = 1").drop("n") for c in ("src", "dst")]
    inside = links.join(single[0], F.col("src") == F.col("_src"), "left_semi").join(single[1], F.col("dst") == F.col("_dst"), "left_semi")
    inside = durable(inside.select(F.col("src").alias("node"), F.col("dst").alias("next")), "runs-inside")
    chains, rings = ranked(nodes.join(inside, "node", "left"))
    tables = [given, inside, chains, rings]
    if not rings.isEmpty():  # a ring is cut behind its least node
        cut = rings.join(inside, "node").select("node", F.when(F.col("node") != F.col("least"), F.col("next")).alias("next"))
        opened, none = ranked(cut)
        tables += [opened, none]
        chains = chains.unionByName(opened)
    members = durable(chains.select("node", F.col("last").alias("run"), F.col("steps").alias("offset")), "runs-members")
    outside = links.join(inside.select(F.col("node").alias("src"), F.col("next").alias("dst")), ["src", "dst"], "left_anti")
    outside = outside.unionByName(rings.where("node = least").join(inside, "node").select(F.col("node").alias("src"), F.col("next").alias("dst")))
    to = members.select(F.col("node").alias("dst"), F.col("run").alias("to_run"), F.col("offset").alias("to_offset"))
    made = Runs(members, durable(outside.join(to, "dst").select(F.col("src").alias("run"), "to_run", "to_offset"), "runs-links"))
    discard(*tables)
    return made


class _Search:
    """The entries ``q, run, offset, depth`` of questions that begin at ``seeds(q, node)``: where each enters a run, and after how many steps.

    An entry leads to all of its run from its offset on.  A round follows the ``links`` behind the last one's entries.  What is known already, as it reaches no run's end sooner and begins none
    earlier than any before, is left out whenever there are twice as many entries as when that was last done, and in every fourth round, so that the work grows with the
    entries and not with their number in every round; up to ``FEW`` entries it always is.  Until then an entry is met again at other depths, which changes no least one.
    """

    FEW = 1_000_000

    def __init__(self, index: Runs, seeds: DataFrame, links: DataFrame | None = None, near: str = "true"):
        self.links, self.near, self.entries = index.links if links is None else links, near, Grown("ancestry-entries")
        self.last = self.entries.add(seeds.join(index.members, "node").select("q", "run", "offset", F.lit(0).cast("bigint").alias("depth")))
        self.n = self.total = self.last.count()
        self.judged = self.since = 0

    def step(self, open_: DataFrame | None = None) -> bool:
        """One more round, from those of the last entries that are ``open_``; whether it found any."""
        met = (self.last if open_ is None else open_).join(self.links, "run").where(self.near)
        ahead = met.groupBy("q", F.col("to_run").alias("run"), F.col("to_offset").alias("offset")).agg(F.min(F.col("depth") + F.col("offset") + 1).alias("depth"))
        self.since += 1
        if self.total <= self.FEW or self.total >= 2 * self.judged or self.since >= 4:
            known = self.entries.all.groupBy("q", "run").agg(F.min(F.col("depth") + F.col("offset")).alias("end"), F.max("offset").alias("begun"))
            ahead = ahead.join(known, ["q", "run"], "left").where("end IS NULL OR depth + offset < end OR offset > begun")
            self.judged, self.since = self.total, 0
        self.last = self.entries.add(ahead.select("q", "run", "offset", "depth"))
        self.n = self.last.count()
        self.total += self.n
        return self.n > 0


def ancestors_of(parents: DataFrame, heads: DataFrame, index: Runs | None = None) -> DataFrame:
    """``revision, ancestor, depth`` for the revisions of ``heads(revision)``: themselves (0) and all before them in ``parents(revision, parent)``, with the least depth.

    What is written for a head is a row for each run that it goes through, and its answer.  Heads that aren't in ``parents`` have none.
    """
    own = index or runs(parents.select(F.col("revision").alias("src"), F.col("parent").alias("dst")))
    search = _Search(own, heads.select(F.col("revision").alias("q"), F.col("revision").alias("node")).distinct())
    while search.step():
        pass
    entries = search.entries
    there = own.members.select("run", F.col("node").alias("ancestor"), F.col("offset").alias("place"))
    met = entries.all.join(there, "run").where("place <= offset").select("q", "ancestor", (F.col("depth") + F.col("offset") - F.col("place")).alias("depth"))
    found = durable(met.groupBy(F.col("q").alias("revision"), "ancestor").agg(F.min("depth").cast("int").alias("depth")), "ancestors")
    entries.drop()
    if index is None:
        own.drop()
    return found


def reached(index: Runs, starts: DataFrame) -> DataFrame:
    """``node``: all that any of ``starts(node)`` leads to, themselves included, as one question: a run is entered once, or anew where it is entered earlier."""
    entries = Grown("reached-entries")
    begin = lambda df: df.groupBy("run").agg(F.max("offset").alias("offset"))
    last = entries.add(begin(starts.select("node").distinct().join(index.members, "node")))
    while not last.isEmpty():
        ahead = begin(last.select("run").join(index.links, "run").select(F.col("to_run").alias("run"), F.col("to_offset").alias("offset")))
        known = begin(entries.all).withColumnRenamed("offset", "begun")
        last = entries.add(ahead.join(known, "run", "left").where("begun IS NULL OR offset > begun").select("run", "offset"))
    whole = begin(entries.all)
    found = durable(index.members.withColumnRenamed("offset", "place").join(whole, "run").where("place <= offset").select("node"), "reached")
    entries.drop()
    return found


def _met(best: DataFrame, ours: DataFrame, theirs: DataFrame, members: DataFrame) -> DataFrame:
    """``ours, theirs, at``: the least (greater distance, sum, base) of where entries of both sides are in one run, if it is no further than ``best(ours, theirs, at)`` has it."""
    side = lambda df, q, k: df.select(F.col("q").alias(q), "run", F.col("offset").alias(f"o{k}"), F.col("depth").alias(f"d{k}"))
    both = best.join(side(ours, "ours", 0), "ours").join(side(theirs, "theirs", 1), ["theirs", "run"]).withColumn("place", F.least("o0", "o1"))
    a, b = [F.col(f"d{k}") + F.col(f"o{k}") - F.col("place") for k in (0, 1)]
    near = both.select("ours", "theirs", "at", "run", "place", F.greatest(a, b).alias("far"), (a + b).alias("sum")).where("at IS NULL OR far <= at.far")
    node = members.select("run", F.col("offset").alias("place"), F.col("node").alias("base"))
    return near.join(node, ["run", "place"]).groupBy("ours", "theirs").agg(F.min(F.struct("far", "sum", "base")).alias("at"))


def merge_base(parents: DataFrame, pairs: DataFrame, index: Runs | None = None) -> DataFrame:
    """``ours, theirs, base`` for ``pairs(ours, theirs)``: the common ancestor with the least (greater distance, sum, id); no row if there is none.

    Each revision of a side is searched from once, for all of its pairs.  The side with fewer goes ahead by twice as many rounds each time, so that what the other side has searched already is
    held against it as often as the logarithm of the rounds; in between only the other side's new entries are.  A pair's best base is kept, and entries as far away as it are not followed.
    """
    own = index or runs(parents.select(F.col("revision").alias("src"), F.col("parent").alias("dst")))
    asked = pairs.select("ours", "theirs").where("ours IS NOT NULL AND theirs IS NOT NULL").distinct()
    n = asked.agg(F.count_distinct("ours").alias("ours"), F.count_distinct("theirs").alias("theirs")).first()
    few, many = ("ours", "theirs") if n.ours < n.theirs else ("theirs", "ours")
    search = {c: _Search(own, asked.select(F.col(c).alias("q"), F.col(c).alias("node")).distinct()) for c in (few, many)}
    best = asked.withColumn("at", F.lit(None).cast(f"struct<far: bigint, sum: bigint, base: {own.members.schema['node'].dataType.simpleString()}>"))

    def update(of_few: DataFrame, of_many: DataFrame) -> DataFrame:
        found = _met(best, *((of_few, of_many) if few == "ours" else (of_many, of_few)), own.members)
        return durable(best.unionByName(found).groupBy("ours", "theirs").agg(F.min("at").alias("at")), "merge-base")

    def open_(c: str) -> DataFrame:
        """The last entries of a side from which some pair's best base could be bettered."""
        bound = best.groupBy(F.col(c).alias("q")).agg(F.max(F.coalesce("at.far", F.lit(2**63 - 1))).alias("bound"))
        return search[c].last.join(bound, "q").where("depth < bound").select("q", "run", "offset", "depth")

    best, done, ahead = update(search[few].entries.all, search[many].entries.all), 0, 2
    while search[few].n or search[many].n:
        begun = len(search[few].entries.parts)
        for _ in range(ahead - done):
            if not search[few].n or not search[few].step(open_(few)):
                break
        fresh = [part for part in search[few].entries.parts[begun:]]
        if fresh and sum(part.count() for part in fresh):
            before, best = best, update(reduce(DataFrame.unionByName, fresh), search[many].entries.all)
            discard(before)
        for _ in range(ahead - done):
            if not search[many].n or not search[many].step(open_(many)):
                break
            before, best = best, update(search[few].entries.all, search[many].last)
            discard(before)
        done, ahead = ahead, 2 * ahead
    for one in search.values():
        one.entries.drop()
    if index is None:
        own.drop()
    return best.where("at IS NOT NULL").select("ours", "theirs", F.col("at.base").alias("base"))


def fast_forward(parents: DataFrame, pairs: DataFrame, index: Runs | None = None) -> DataFrame:
    """``old, new, fast_forward`` for ``pairs(old, new)``: whether ``old`` is ``new`` or before it; a question ends when it has been reached.

    If there are as many questions as revisions, the levels of all are found first, as nothing leads to a revision of its own level or a higher one: a question then goes no deeper than what it looks for.
    """
    edges = parents.select(F.col("revision").alias("src"), F.col("parent").alias("dst"))
    own = index or runs(edges)
    aim = own.members.select(F.col("node").alias("old"), F.col("run").alias("aim"), F.col("offset").alias("place"))
    asked = pairs.select("old", "new").distinct().join(aim, "old")
    made, links, near, low = [], own.links, "true", F.lit(0)
    if asked.count() >= own.members.count():
        at, on = levels(edges, own)
        level = lambda c: at.select(F.col("node").alias(c), "level")
        # what has no level is on a cycle or leads to one: it is followed, and nothing with a level leads to it
        links = durable(own.links.join(level("to_run"), "to_run", "left").select("run", "to_run", "to_offset", (F.col("level") + F.col("to_offset")).alias("to_level")), "fast-forward-links")
        asked, low = asked.join(level("aim"), "aim", "left"), F.coalesce(F.col("level") + F.col("place"), F.lit(2**63 - 1))
        near = "to_level IS NULL OR to_level > q.low OR to_run = q.aim AND to_offset >= q.place"
        made = [at, on, links]
    seeds = asked.select(F.struct("old", "new", "aim", "place", low.cast("bigint").alias("low")).alias("q"), F.col("new").alias("node"))
    hit = lambda entries: entries.where("run = q.aim AND offset >= q.place").select("q").distinct()
    search = _Search(own, seeds, links, near)
    while search.step(search.last.join(hit(search.last), "q", "left_anti")):
        pass
    reached = hit(search.entries.all).select("q.old", "q.new", F.lit(True).alias("_is"))
    answer = durable(pairs.join(reached, ["old", "new"], "left").select("old", "new", F.coalesce("_is", F.lit(False)).alias("fast_forward")), "fast-forward")
    search.entries.drop()
    discard(*made)
    if index is None:
        own.drop()
    return answer


def _stripped(runs_: DataFrame, links: DataFrame) -> Grown:
    """``run, level, length``: in rounds those of ``runs_(run, length)`` all of whose ``links(run, to_run)`` lead to stripped ones, with the longest way to one without a link."""
    needs = links.groupBy("run").agg(F.count(F.lit(1)).alias("needs"))
    facts = durable(runs_.join(needs, "run", "left"), "stripped-needs")  # asked in every round
    done, hits = Grown("stripped"), Grown("stripped-hits")
    last = done.add(facts.where("needs IS NULL").select("run", F.lit(0).cast("bigint").alias("level"), "length"))
    while not last.isEmpty():
        below = last.select(F.col("run").alias("to_run"), (F.col("level") + F.col("length") + 1).alias("level"))
        touched = hits.add(links.join(below, "to_run").groupBy("run").agg(F.count(F.lit(1)).alias("n"), F.max("level").alias("level")))
        met = hits.all.join(touched.select("run"), "run", "left_semi").groupBy("run").agg(F.sum("n").alias("n"), F.max("level").alias("level"))
        last = done.add(met.join(facts, "run").where("n = needs").select("run", "level", "length"))
    hits.drop()
    discard(facts)
    return done


def levels(edges: DataFrame, index: Runs | None = None) -> tuple[DataFrame, DataFrame]:
    """``node, level`` and ``node, cycle`` of ``edges(src, dst)``: the longest way from each node to one without a link, and the sets in which every node leads to every other.

    Rounds strip the runs that lead to stripped ones alone, and no row is written twice.  What is left is on a cycle or leads to one: it is stripped from the other side
    as well, and the rest is cut into strongly connected sets, which are named by their least node.  A node that leads to a cycle and is on none is in neither table.
    """
    own = index or runs(edges)
    links = durable(own.links.select("run", "to_run").distinct(), "levels-links")
    done = _stripped(own.members.groupBy("run").agg(F.max("offset").alias("length")), links)
    left = durable(links.join(done.all.select("run"), "run", "left_anti").join(done.all.select(F.col("run").alias("to_run")), "to_run", "left_anti").select("run", "to_run"), "levels-left")
    tails = _stripped(left.select("run").union(left.select("to_run")).distinct().select("run", F.lit(0).cast("bigint").alias("length")), left.select(F.col("to_run").alias("run"), F.col("run").alias("to_run")))
    core = durable(left.join(tails.all.select("run"), "run", "left_anti").join(tails.all.select(F.col("run").alias("to_run")), "to_run", "left_anti").select(F.col("run").alias("src"), F.col("to_run").alias("dst")), "levels-core")
    # without what led to it or from it, a ring is a run again, and is found in as many rounds as the logarithm of its length
    again = runs(core)
    loops = durable(again.links.select(F.col("run").alias("src"), F.col("to_run").alias("dst")).distinct(), "levels-loops")
    whole = components(loops)
    sets = durable(again.members.join(whole.withColumnRenamed("of", "run"), "run").select(F.col("node").alias("of"), "set"), "levels-sets")
    again.drop()
    discard(loops, whole)
    at = durable(own.members.join(done.all, "run").select("node", (F.col("level") + F.col("offset")).alias("level")), "levels")
    on = own.members.join(sets, F.col("run") == F.col("of")).select("node", "set")
    cycles = durable(on.join(on.groupBy("set").agg(F.min("node").alias("cycle")), "set").select("node", "cycle"), "cycles")
    done.drop()
    tails.drop()
    discard(links, left, core, sets)
    if index is None:
        own.drop()
    return at, cycles


def rings(pointers: DataFrame) -> DataFrame:
    """``node, least`` of ``pointers(node, next)``, in which each node has one row at most: the nodes on a ring, each with the least of its ring.

    Every round doubles how far a pointer leads, and keeps only the nodes that some pointer leads to, as those on a ring always are.  So ways into a ring or to an end cost as many
    rounds as the logarithm of their length, however many there are, and when no node goes any more all that are left are on rings.
    """
    last = durable(pointers.select("node", F.col("next").alias("to"), F.col("node").alias("least")), "rings")
    n, span, settled = last.count(), 1, False
    while n and not (settled and span >= n):
        aims = last.select(F.col("to").alias("node")).distinct()
        further = last.select(F.col("node").alias("at"), F.col("to").alias("on"), F.col("least").alias("low"))
        moved = last.join(aims, "node", "left_semi").join(further, F.col("to") == F.col("at"))
        before, last = last, durable(moved.select("node", F.col("on").alias("to"), F.least("least", "low").alias("least")), "rings")
        discard(before)
        m = last.count()
        n, span, settled = m, 2 * span, m == n
    return last.select("node", "least")


def cycles(edges: DataFrame) -> DataFrame:
    """``node, cycle``: as the second table of :func:`levels`, without the levels, and so without rounds for every step of a way.

    A node with a single link is passed by pointers, which double.  What they end in are nodes of several links; only these are searched by :func:`levels`, with a link for each way between
    them.  The nodes on a way within a set are marked by the same pointers, from the widest to the nearest.
    """
    links = durable(edges.select("src", "dst").where("src IS NOT NULL AND dst IS NOT NULL").distinct(), "cycles-links")
    many = durable(links.groupBy("src").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col("src").alias("node")), "cycles-many")
    single = links.join(many.withColumnRenamed("node", "src"), "src", "left_anti").select(F.col("src").alias("node"), F.col("dst").alias("next"))
    alone = rings(single)
    if many.isEmpty():
        found = durable(alone.select("node", F.col("least").alias("cycle")), "cycles")
        discard(links, many, alone)
        return found
    ways, span = Grown("cycles-ways"), 1
    last = ways.add(many.select("node", F.col("node").alias("to"), F.lit(True).alias("ended")).unionByName(single.select("node", F.col("next").alias("to"), F.lit(False).alias("ended"))))
    n = last.count()
    while span < n and not last.where("NOT ended").isEmpty():
        further = ways.all.where("ended").unionByName(last.where("NOT ended")).select(F.col("node").alias("at"), F.col("to").alias("on"), F.col("ended").alias("there"))
        last = ways.add(last.where("NOT ended").join(further, F.col("to") == F.col("at")).select("node", F.col("on").alias("to"), F.col("there").alias("ended")))
        span *= 2
    ends = ways.all.where("ended").select(F.col("node").alias("dst"), F.col("to").alias("end"))
    between = durable(links.join(many.withColumnRenamed("node", "src"), "src").join(ends, "dst").select("src", "dst", "end"), "cycles-between")
    at, sets = levels(between.select("src", F.col("end").alias("dst")))
    of = lambda c: sets.select(F.col("node").alias(c), F.col("cycle").alias(f"{c}_set"))
    inside = between.join(of("src"), "src").join(of("end"), "end").where("src_set = end_set").select(F.col("dst").alias("node"), F.col("src_set").alias("set")).distinct()
    marked = durable(inside.union(sets.select("node", F.col("cycle").alias("set"))).distinct(), "cycles-marked")
    for part in reversed(ways.parts):
        step = marked.join(part.where("NOT ended"), "node").select(F.col("to").alias("node"), "set")
        before, marked = marked, durable(marked.union(step).distinct(), "cycles-marked")
        discard(before)
    named = marked.groupBy("set").agg(F.min("node").alias("cycle"))
    found = durable(marked.join(named, "set").select("node", "cycle").unionByName(alone.select("node", F.col("least").alias("cycle"))), "cycles")
    ways.drop()
    discard(links, many, alone, between, at, sets, marked)
    return found


def _spread(start: DataFrame, edges: DataFrame) -> DataFrame:
    """``node, label``: the least label of ``start(node, label)`` that leads to each node along ``edges(src, dst)``, in rounds over what changed."""
    found = Grown("spread")
    last = found.add(start)
    while not last.isEmpty():
        told = last.join(edges, F.col("node") == F.col("src")).select(F.col("dst").alias("node"), "label").groupBy("node").agg(F.min("label").alias("label"))
        known = found.all.groupBy("node").agg(F.min("label").alias("best"))
        last = found.add(told.join(known, "node", "left").where("best IS NULL OR label < best").select("node", "label"))
    out = durable(found.all.groupBy("node").agg(F.min("label").alias("label")), "spread-labels")
    found.drop()
    return out


def components(edges: DataFrame) -> DataFrame:
    """``of, set``: the strongly connected sets of ``edges(src, dst)`` that have a cycle, named by their least node.

    Each round gives every node the least one that leads to it.  The nodes that are their own are in different sets, and what they lead to and what leads back to them under
    the same name is such a set; sets are taken out until no edge is left.  Edges between nodes of different names belong to no set and go at once.
    """
    found = Grown("components")
    found.add(edges.select(F.col("src").alias("of"), F.col("src").alias("set")).where("false"))
    open_ = durable(edges.select("src", "dst").distinct(), "components-open")
    while not open_.isEmpty():
        nodes = open_.select(F.col("src").alias("node")).union(open_.select("dst")).distinct()
        names = _spread(nodes.select("node", F.col("node").alias("label")), open_)
        name = lambda c: names.select(F.col("node").alias(c), F.col("label").alias(f"{c}_name"))
        within = durable(open_.join(name("src"), "src").join(name("dst"), "dst").where("src_name = dst_name").select("src", "dst", F.col("src_name").alias("name")), "components-within")
        back = within.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
        roots = names.where("node = label").select("node", "label")
        reached = _spread(roots, back)
        sets = found.add(reached.join(within.select(F.col("src").alias("node")).union(within.select("dst")).distinct(), "node", "left_semi").select(F.col("node").alias("of"), F.col("label").alias("set")))
        taken = lambda c: sets.select(F.col("of").alias(c))
        before, open_ = open_, durable(within.join(taken("src"), "src", "left_anti").join(taken("dst"), "dst", "left_anti").select("src", "dst"), "components-open")
        discard(before, names, within, reached)
    discard(open_)
    # a node alone is a set with a cycle only if it leads to itself
    own = edges.where("src = dst").select(F.col("src").alias("of")).distinct().withColumn("_own", F.lit(True))
    sized = found.all.groupBy("set").agg(F.count(F.lit(1)).alias("n"))
    out = durable(found.all.join(sized, "set").join(own, "of", "left").where("n > 1 OR _own").select("of", "set"), "components-sets")
    found.drop()
    return out


def intervals(tree: DataFrame) -> DataFrame:
    """``node, enter, leave`` of each node of a forest ``tree(sub, sup)``: one node is below another exactly if its interval is within the other's.

    An Euler tour goes down to each node and up from it, its children in order, and the roots one after the other.  What comes next in the tour is known for each step by itself, and the
    steps' places are found by :func:`ranked`; no closure is made, and a node with very many children is no group.  A null ``sup`` marks a node that is by itself; nodes on a cycle or below one have no
    interval, and of a node with several parents the least counts.
    """
    up = tree.where("sub IS NOT NULL").groupBy("sub").agg(F.min("sup").alias("sup"))
    rows = durable(up.unionByName(tree.where("sup IS NOT NULL").select(F.col("sup").alias("sub")).distinct().join(up, "sub", "left_anti").withColumn("sup", F.lit(None).cast(tree.schema["sup"].dataType))).repartitionByRange("sup", "sub").withColumn("part", F.spark_partition_id()), "intervals-rows")
    kind = rows.schema["sub"].dataType.simpleString()
    # roots follow each other like the children of one node
    keyed = rows.select(F.struct(F.col("sup").isNull().alias("top"), "sup").alias("of"), "sub", "sup", "part")
    after = durable(following(keyed, "of", ["sub"], "sub", F.col("part")).select("sub", "sup", F.col("following").alias("beside")), "intervals-after")
    first = rows.groupBy("sup").agg(F.min("sub").alias("child")).where("sup IS NOT NULL")
    step = lambda node, down: F.struct(node.cast(kind).alias("node"), F.lit(down).alias("down"))
    downs = after.join(first.withColumnRenamed("sup", "_sup"), F.col("sub") == F.col("_sup"), "left")
    downs = downs.select(step(F.col("sub"), True).alias("node"), F.when(F.col("child").isNotNull(), step(F.col("child"), True)).otherwise(step(F.col("sub"), False)).alias("next"))
    on = F.when(F.col("beside").isNotNull(), step(F.col("beside"), True)).when(F.col("sup").isNotNull(), step(F.col("sup"), False))
    ends, rings = ranked(downs.unionByName(after.select(step(F.col("sub"), False).alias("node"), on.alias("next"))))
    n = after.count()
    place = (F.lit(2 * n - 1) - F.col("steps")).alias("place")
    placed = ends.select("node.node", "node.down", place)
    side = lambda down, name: F.min(F.when(F.col("down") == down, F.col("place"))).alias(name)
    out = durable(placed.groupBy("node").agg(side(True, "enter"), side(False, "leave")), "intervals")
    discard(rows, after, ends, rings)
    return out


def is_below(labels: DataFrame, pairs: DataFrame) -> DataFrame:
    """``pairs(sub, sup)`` with ``below``: whether ``sub`` is ``sup`` or under it, by the intervals of :func:`intervals`; false if either has none."""
    of = lambda c: labels.select(F.col("node").alias(c), F.col("enter").alias(f"{c}_enter"), F.col("leave").alias(f"{c}_leave"))
    both = pairs.join(of("sub"), "sub", "left").join(of("sup"), "sup", "left")
    return both.select("sub", "sup", F.coalesce((F.col("sup_enter") <= F.col("sub_enter")) & (F.col("sub_leave") <= F.col("sup_leave")), F.lit(False)).alias("below"))


def nearest(tree: DataFrame, marked: DataFrame) -> DataFrame:
    """``node, owner, depth``: the nearest node of ``marked(node)`` at or above each node of ``tree(sub, sup)``; no row if there is none, or a cycle comes first.

    Every node points at its parent until one is marked, and pointers are followed in doubling rounds, as many as the logarithm of the longest way.
    """
    up = tree.where("sub IS NOT NULL AND sup IS NOT NULL").groupBy("sub").agg(F.min("sup").alias("to"))
    nodes = tree.select(F.col("sub").alias("node")).union(tree.select("sup")).union(marked.select("node")).where("node IS NOT NULL").distinct()
    flagged = nodes.join(marked.select("node").distinct().withColumn("own", F.lit(True)), "node", "left").join(up.withColumnRenamed("sub", "node"), "node", "left")
    state = durable(flagged.select("node", F.when(F.col("own"), F.col("node")).otherwise(F.col("to")).alias("to"), F.when(F.col("own"), 0).otherwise(1).cast("bigint").alias("depth"), F.coalesce("own", F.lit(False)).alias("own")).where("to IS NOT NULL"), "nearest")
    n, span = state.count(), 1
    while span < n and not state.where("NOT own").isEmpty():
        further = state.select(F.col("node").alias("at"), F.col("to").alias("on"), F.col("depth").alias("more"), F.col("own").alias("there"))
        met = state.join(further, F.col("to") == F.col("at"))
        moved = met.where("NOT own").select("node", F.col("on").alias("to"), (F.col("depth") + F.col("more")).alias("depth"), F.col("there").alias("own"))
        before, state = state, durable(state.where("own").unionByName(moved), "nearest")
        discard(before)
        span *= 2
    return state.where("own").select("node", F.col("to").alias("owner"), F.col("depth").cast("int").alias("depth"))
