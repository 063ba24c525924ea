"""Graph operators over an edge table (source, target, relation, weight, metadata, created_at).

Traversals advance whole frontiers by equi-joins; every round is cut with a checkpoint in
the shared folder. All starts are traversed at once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestrand.tables import cut

# fixed values: the relations a causal chain follows, and the structural ones
CAUSAL = ["caused_by", "triggers", "leads_to", "correlated_with", "depends_on_causal", "resulted_in"]
STRUCTURAL = ["calls", "imports", "contains", "depends_on"]
# fixed values: relation, class of its source, class of its target, in the order of the ontology
ONTOLOGY = [
    ("implements", "Decision", "Requirement"),
    ("realizes", "Commit", "Decision"),
    ("modifies", "Commit", "Function"),
    ("triggers", "Incident", "Decision"),
    ("validates", "Experiment", "Decision"),
    ("overrides", "Decision", "Decision"),
    ("fixes", "Commit", "Incident"),
]
# fixed values: event type to ontology class, as linking reads it
LINK_CLASS = [("decision", "Decision"), ("git_commit", "Commit"), ("code_change", "Commit"), ("incident", "Incident"), ("experiment", "Experiment"), ("requirement", "Requirement"), ("convention", "Convention")]


def class_of(col) -> F.Column:
    """Ontology class of an event type; null where there is none."""
    out = F
    for t, c in LINK_CLASS:
        out = out.when(col == t, c)
    return out.otherwise(None)


_EDGE = ["source", "target", "relation"]


def merged_metadata(rows: DataFrame, unite_lists: bool = True) -> DataFrame:
    """(source, target, relation, metadata): the rows' metadata merged in order of ``created_at``, then of its text.

    A later value of a key takes the place of an earlier one; with ``unite_lists`` a list that
    follows a list adds the elements not yet there. Keys are sorted. Metadata that is no JSON
    object counts as empty.
    """
    order = F.struct("created_at", F.col("metadata").alias("m"))
    v = rows.where(F.is_variant_null(F.try_parse_json("metadata")).isNotNull() & F.col("metadata").rlike(r"^\s*\{"))
    v = v.select(*_EDGE, order.alias("o"), F.try_parse_json("metadata").alias("v")).lateralJoin(rows.sparkSession.tvf.variant_explode(F.col("v").outer()))
    v = v.select(*_EDGE, "o", "key", "value").where("key is not null")
    is_list = F.schema_of_variant("value").startswith("ARRAY") if unite_lists else F.lit(False)
    v = v.select(*_EDGE, "o", "key", F.to_json("value").alias("j"), is_list.alias("l"), F.when(is_list, F.col("value").cast("array<variant>")).alias("a"))
    # the last value that is no list, and the lists behind it
    k = [*_EDGE, "key"]
    single = v.where("not l").groupBy(*k).agg(F.max(F.struct("o", "j")).alias("s"))
    items = v.where("l").join(single.select(*[F.col(c).alias(f"{c}_k") for c in k], "s"), [F.col(c).eqNullSafe(F.col(f"{c}_k")) for c in k], "left").where("s is null or o > s.o")
    items = items.select(*k, F.col("o"), F.posexplode_outer("a").alias("at", "x")).select(*k, "o", "at", F.to_json("x").alias("x"))
    first = items.groupBy(*k, "x").agg(F.min(F.struct("o", "at")).alias("f"))
    united = first.groupBy(*k).agg(F.array_sort(F.collect_list(F.when(F.col("x").isNotNull(), F.struct("f", "x")))).alias("xs"))  # one value's own elements
    united = united.select(*k, F.concat(F.lit("["), F.array_join(F.transform("xs", lambda e: e["x"]), ","), F.lit("]")).alias("j"))
    alone = single.select(*k, "s.j").join(united.select(*k), k, "left_anti")
    both = united.unionByName(alone).select(*_EDGE, F.struct("key", F.concat(F.lit('"'), "key", F.lit('":'), "j").alias("t")).alias("e"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list("e")), lambda e: e["t"]), ",")  # the keys of one edge
    return both.groupBy(*_EDGE).agg(F.concat(F.lit("{"), text, F.lit("}")).alias("metadata"))


def merged_edges(edges: DataFrame, unite_lists: bool = True) -> DataFrame:
    """One row per (source, target, relation): greatest weight, first creation, merged metadata."""
    base = edges.groupBy(*_EDGE).agg(F.max("weight").alias("weight"), F.min("created_at").alias("created_at"))
    meta = merged_metadata(edges, unite_lists).select(*[F.col(c).alias(f"{c}_k") for c in _EDGE], "metadata")
    j = base.join(meta, [F.col(c).eqNullSafe(F.col(f"{c}_k")) for c in _EDGE], "left")
    return j.select(*_EDGE, "weight", F.coalesce("metadata", F.lit("{}")).alias("metadata"), "created_at")


def related(edges: DataFrame, starts: DataFrame) -> DataFrame:
    """(start, id): neighbours in both directions at distance one, without the start itself."""
    both = edges.select(F.col("source").alias("start"), F.col("target").alias("id")).union(edges.select("target", "source"))
    return both.join(starts.select("start").distinct(), "start", "left_semi").where("start <> id").distinct()


def k_hop(edges: DataFrame, starts: DataFrame, depth: int) -> DataFrame:
    """(start, id, level): nodes within ``depth`` steps in either direction, at their least level.

    Up to two levels are one plan; of deeper walks each level but the last is written.
    """
    step = edges.select(F.col("source").alias("id"), F.col("target").alias("next")).union(edges.select("target", "source"))
    seen = front = starts.select("start", F.col("start").alias("id"), F.lit(0).alias("level")).distinct()
    for level in range(1, depth + 1):
        front = front.join(step, "id").select("start", F.col("next").alias("id"), F.lit(level).alias("level"))
        if level < depth:
            front = front.distinct()
            if depth > 2:
                front = cut(front.join(seen.select("start", "id"), ["start", "id"], "left_anti").select("start", "id", "level"))
        seen = seen.unionByName(front)
    return seen.groupBy("start", "id").agg(F.min("level").alias("level"))  # what was met before keeps its level


def edges_within(edges: DataFrame, starts: DataFrame, depth: int = 2) -> DataFrame:
    """(start, source, target, relation, level): the edges at either end of the nodes within ``depth`` steps, at the least level of such an end."""
    near = k_hop(edges, starts, depth)
    e = edges.select(*_EDGE).distinct()
    ends = e.withColumn("id", F.col("source")).unionByName(e.withColumn("id", F.col("target")))
    return ends.join(near, "id").groupBy("start", *_EDGE).agg(F.min("level").alias("level"))


def reach(edges: DataFrame, starts: DataFrame, backward: bool = False) -> DataFrame:
    """(start, id): everything reachable along (or against) the edges, without the start unless on a cycle back.

    Rounds go on until nothing new is met; what was seen is written together every eight rounds.
    """
    a, b = ("target", "source") if backward else ("source", "target")
    step = edges.select(F.col(a).alias("id"), F.col(b).alias("next")).distinct()
    front = cut(starts.select("start", F.col("start").alias("id")).distinct().join(step, "id").select("start", F.col("next").alias("id")).distinct())
    seen, rounds = front, 0
    while not front.isEmpty():
        new = front.join(step, "id").select("start", F.col("next").alias("id")).distinct()
        front = cut(new.join(seen, ["start", "id"], "left_anti"))
        seen, rounds = seen.unionByName(front), rounds + 1
        if rounds % 8 == 0:
            seen = cut(seen)
    return seen.where("start <> id")


def causal_chain(edges: DataFrame, starts: DataFrame, depth: int = 3) -> DataFrame:
    """(start, id, level, position): causes of each start, breadth first against causal edges.

    Among the causes found from one node: latest edge first, then source, then relation. A
    node counts where it is met first; the start is never listed.
    """
    e = edges.where(F.col("relation").isin(CAUSAL)).groupBy("source", "target").agg(F.min(F.struct((-F.col("created_at")).alias("c"), "relation")).alias("o"))
    e = e.select(F.col("target").alias("id"), F.col("source").alias("next"), F.struct("o.c", "source", "o.relation").alias("o"))
    seen = starts.select("start", F.col("start").alias("id"), F.lit(0).alias("level"), F.lit(0).cast("long").alias("place")).distinct()
    front = seen
    for level in range(1, depth + 1):
        new = front.join(e, "id").select("start", F.col("next").alias("id"), F.struct(F.col("place").alias("p"), F.col("o.c").alias("c"), F.col("o.source").alias("s"), F.col("o.relation").alias("r")).alias("o"))
        new = new.groupBy("start", "id").agg(F.min("o").alias("o")).join(seen.select("start", "id"), ["start", "id"], "left_anti")
        # a start's own level only; the group is the causes of one start
        w = Window.partitionBy("start").orderBy("o")
        front = cut(new.select("start", "id", F.lit(level).alias("level"), F.row_number().over(w).cast("long").alias("place")))
        seen = seen.unionByName(front)
        if front.isEmpty():
            break
    w = Window.partitionBy("start").orderBy("level", "place")
    return seen.where("level > 0").select("start", "id", "level", F.row_number().over(w).alias("position"))


def cyclic_edges(edges: DataFrame) -> DataFrame:
    """(source, target): the edges inside strongly connected components, without loops.

    Nodes without in- or out-edge are trimmed first. Then each node takes the least id that reaches it, and the least that
    it reaches; an edge between different labels is on no cycle. When nothing goes any more, the least node of each
    component reaches all of it and is reached from all of it.
    """

    def trimmed(e):
        for _ in range(3):
            e = e.join(e.select(F.col("target").alias("source")).distinct(), "source", "left_semi")
            e = e.join(e.select(F.col("source").alias("target")).distinct(), "target", "left_semi")
        return e.select("source", "target")

    def labels(e, a, b):
        """(id, label): the least id from which ``id`` is reached along a -> b, itself included."""
        at = cut(e.select(F.col(a).alias("id")).union(e.select(b)).distinct().withColumn("label", F.col("id")))
        while True:
            come = at.join(e.select(F.col(a).alias("id"), F.col(b).alias("to")), "id").select(F.col("to").alias("id"), "label")
            nxt = cut(at.withColumn("was", F.col("label")).unionByName(come, allowMissingColumns=True).groupBy("id").agg(F.min("label").alias("label"), F.max("was").alias("was")))
            at = nxt.select("id", "label")
            if nxt.where("label <> was").isEmpty():
                return at

    e = cut(edges.where("source <> target").select("source", "target").distinct())
    n, labelled = e.count(), False
    while n:
        nxt = trimmed(e) if not labelled else e
        if labelled:
            for a, b in (("source", "target"), ("target", "source")):
                by = labels(nxt, a, b)
                ends = nxt.join(by.select(F.col("id").alias("source"), F.col("label").alias("x")), "source").join(by.select(F.col("id").alias("target"), F.col("label").alias("y")), "target")
                nxt = cut(ends.where("x = y").select("source", "target"))
        e = cut(nxt)
        left = e.count()
        if left == n and labelled:
            break
        labelled, n = left == n, left  # labels only where trimming takes no more
    return e


def all_cycles(edges: DataFrame) -> DataFrame:
    """(cycle, length): the simple cycles of any length, each once, least node first.

    Paths grow inside the components until none is left; their number is that of the graph's simple paths there.
    """
    e = cyclic_edges(edges)
    found = edges.where("source = target").select(F.array("source").alias("path")).distinct()
    paths, grown = e.where("source < target").select(F.array("source", "target").alias("path")), 0
    while not paths.isEmpty():
        nxt = cut(paths.select("path", F.element_at("path", -1).alias("source"), F.element_at("path", 1).alias("first")).join(e, "source"))
        found = found.unionByName(nxt.where("target = first").select("path"))
        paths = nxt.where((F.col("target") > F.col("first")) & ~F.array_contains("path", F.col("target"))).select(F.concat("path", F.array("target")).alias("path"))
        grown += 1
        if grown % 16 == 0:
            found = cut(found)
    return found.select(F.array_join("path", " -> ").alias("cycle"), F.size("path").alias("length")).distinct()


def degrees(edges: DataFrame) -> DataFrame:
    """(id, n_out, n_in, degree)."""
    ends = edges.select(F.col("source").alias("id"), F.lit(1).alias("o"), F.lit(0).alias("i")).union(edges.select("target", F.lit(0), F.lit(1)))
    return ends.groupBy("id").agg(F.sum("o").alias("n_out"), F.sum("i").alias("n_in"), F.count("*").alias("degree"))


def band_join(left: DataFrame, right: DataFrame, at: str, window: int, keys: list[str] | None = None) -> DataFrame:
    """Pairs with equal ``keys`` and 0 <= left.at - right.at <= window, as an equi-join on slots of the window's width.

    The right side is replicated to its own and the next slot; both sides keep all columns,
    the right ones prefixed ``past_``.
    """
    a = left.withColumn("_slot", F.floor(F.col(at) / window))
    b = right.select([F.col(c).alias(f"past_{c}") for c in right.columns])
    b = b.withColumn("_slot", F.explode(F.array(F.floor(F.col(f"past_{at}") / window), F.floor(F.col(f"past_{at}") / window) + 1)))
    gap = F.col(at) - F.col(f"past_{at}")
    keys = keys or []
    j = a.join(b.withColumnsRenamed({f"past_{c}": c for c in keys}), ["_slot", *keys])
    return j.where((gap >= 0) & (gap <= window)).drop("_slot")


SALTS = 8  # parts of a busy time slot


def time_links(events: DataFrame, window_s: int = 7200) -> DataFrame:
    """(source, target, relation, weight): rule-based links between events of one time window.

    What an event says is read once, before the join: only events that say what a rule asks
    for meet the kind of event the rule names, by rule, time slot and salt.
    """
    said = F.lower(F.col("summary"))
    kind = F.when(F.col("type").isin("git_commit", "code_change"), "c").when(F.col("type") == "decision", "d")
    kind = kind.when((F.col("type") == "incident") | (F.col("type").isin("diagnostic", "unknown") & said.rlike("error|fail|exception|bug|crash")), "i")
    e = events.select("id", F.unix_micros(F.col("timestamp").cast("timestamp")).alias("us"), kind.alias("k"), said.alias("said")).where("k is not null")
    asks = F.filter(
        F.array(
            F.when((F.col("k") == "c") & F.col("said").rlike("fix|resolv|close"), "fixes"),
            F.when((F.col("k") == "c") & F.col("said").rlike("implement|feat|reali"), "realizes"),
            F.when((F.col("k") == "d") & F.col("said").rlike("incident|outage|fail|fix"), "triggers"),
        ),
        lambda x: x.isNotNull(),
    )
    salt = F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int")
    later = e.select("id", "us", F.explode(asks).alias("relation"), salt.alias("salt"))
    past = e.select("id", "us", F.explode(F.when(F.col("k") == "i", F.array(F.lit("fixes"), F.lit("triggers"))).when(F.col("k") == "d", F.array(F.lit("realizes"))).otherwise(F.array())).alias("relation"))
    past = past.withColumn("salt", F.explode(F.array(*[F.lit(i) for i in range(SALTS)])))
    pairs = band_join(later, past, "us", window_s * 1_000_000, ["relation", "salt"])
    # the past event comes first; equal times by id
    pairs = pairs.where("past_us < us or (past_us = us and past_id < id)")
    back = F.col("relation") == "triggers"
    return pairs.select(
        F.when(back, F.col("past_id")).otherwise(F.col("id")).alias("source"), F.when(back, F.col("id")).otherwise(F.col("past_id")).alias("target"), "relation", F.lit(0.7).alias("weight")
    )


def inferred_relation(a_class, b_class) -> tuple[F.Column, F.Column]:
    """Relation from a to b by the ontology, else from b to a; and whether it is reversed."""
    fwd, rev = F, F
    for rel, dom, rng in ONTOLOGY:
        fwd = fwd.when((a_class == dom) & (b_class == rng), rel)
        rev = rev.when((b_class == dom) & (a_class == rng), rel)
    fwd, rev = fwd.otherwise(None), rev.otherwise(None)
    return F.coalesce(fwd, rev), fwd.isNull() & rev.isNotNull()


def causal_gate(pairs: DataFrame, jitter_s: float = 1.0) -> DataFrame:
    """Each proposed causal pair with ``reason``: null if accepted, else time or isolation.

    Expects s_us, t_us, s_anchors, t_anchors (arrays), s_global, t_session.
    """
    late = F.col("t_us") + F.lit(int(jitter_s * 1e6)) < F.col("s_us")
    shared = F.array_intersect("s_anchors", "t_anchors")
    broadcast = F.coalesce(F.col("s_global"), F.lit(False)) & F.col("t_session").isNotNull()
    return pairs.withColumn("shared", shared).withColumn("broadcast", (F.size("shared") == 0) & broadcast).withColumn(
        "reason", F.when(late, "time").when((F.size("shared") == 0) & ~broadcast, "isolation")
    )


def unknown_relations(edges: DataFrame, types: DataFrame) -> DataFrame:
    """(source, target, relation, reason): relations not defined, or with a wrong class at either end. ``types``: (id, class)."""
    name, dom, rng = F, F, F
    for r, d, g in ONTOLOGY:
        name, dom, rng = name.when(F.col("relation") == r, True), dom.when(F.col("relation") == r, d), rng.when(F.col("relation") == r, g)
    e = edges.select("source", "target", "relation").distinct()
    e = e.join(types.select(F.col("id").alias("source"), F.col("class").alias("sc")), "source", "left").join(types.select(F.col("id").alias("target"), F.col("class").alias("tc")), "target", "left")
    bad = lambda have, want: ~F.coalesce(have == want, F.lit(False))
    reason = F.when(name.otherwise(None).isNull(), "undefined").when(bad(F.col("sc"), dom.otherwise(None)), "domain").when(bad(F.col("tc"), rng.otherwise(None)), "range")
    return e.withColumn("reason", reason).where("reason is not null").select("source", "target", "relation", "reason")


def commits_without_cause(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Commits (id) with no outgoing realizes or fixes edge. ``nodes``: (id, type)."""
    commits = nodes.where((F.col("type") == "commit") | F.col("type").endswith("commit")).select("id").distinct()
    return commits.join(edges.where(F.col("relation").isin("realizes", "fixes")).select(F.col("source").alias("id")), "id", "left_anti")


def untraced_functions(edges: DataFrame) -> DataFrame:
    """(function, n_commits, first_commit): functions modified by commits that realize nothing."""
    mod = edges.where("relation = 'modifies'").select(F.col("source").alias("c"), F.col("target").alias("function")).distinct()
    left = mod.join(edges.where("relation = 'realizes'").select(F.col("source").alias("c")).distinct(), "c", "left_anti")
    return left.groupBy("function").agg(F.count("*").alias("n_commits"), F.min("c").alias("first_commit"))


def layer_violations(deps: DataFrame, layers: list[str]) -> DataFrame:
    """(source, target): dependencies of a lower layer on a higher one; layers by name contained in the module."""
    rank = lambda c: F.coalesce(*[F.when(F.col(c).contains(n), F.lit(i)) for i, n in enumerate(layers)])
    return deps.where(rank("source") > rank("target")).select("source", "target").distinct()


def forbidden_dependencies(deps: DataFrame, rules: list[tuple[str, str]]) -> DataFrame:
    """(source, target, rule): dependencies that a rule forbids; ``*`` at either end stands for any module. The first rule that matches counts."""
    hit = F
    for a, b in rules:
        cond = F.lit(True)
        cond = cond & (F.col("source") == a) if a != "*" else cond
        cond = cond & (F.col("target") == b) if b != "*" else cond
        hit = hit.when(cond, f"{a} -> {b}")
    return deps.select("source", "target", hit.otherwise(None).alias("rule")).where("rule is not null").distinct()


def file_imports(facts: DataFrame, names: DataFrame) -> DataFrame:
    """(source, target): files and the files they import. ``facts``: imports (file_path, name); ``names``: (module, file_path)."""
    i = facts.where("kind = 'import'").select(F.col("file_path").alias("source"), F.col("name").alias("module")).distinct()
    return i.join(names.select("module", F.col("file_path").alias("target")), "module").select("source", "target").where("source <> target").distinct()
