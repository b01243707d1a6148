"""Run a plan: one lazy DataFrame graph with a few validating aggregations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quantloom.errors import EXAMPLES, AxisCoercionError, ColumnComputationError, some
from quantloom.functions import sequences, text
from quantloom.functions.unimod import unimod
from quantloom.functions.values import COERCE, drop_tokens, normalize_missing, unreadable
from quantloom.operators import axis, cells, layers, layout
from quantloom.operators.axis import Policy, field, q
from quantloom.plans.resolve import Plan
from quantloom.plans.rules import ColumnRule
from quantloom.result import OBS, VAR, LayerInfo, Level
from quantloom.store.shared import written

ORDER = "_ord"


def _sourced(df: DataFrame, columns: tuple[ColumnRule, ...], keep: list[str]) -> DataFrame:
    """Logical columns from physical ones; declared tokens become missing."""
    return df.select(*[drop_tokens(q(c.source), c.missing_tokens).alias(c.name) for c in columns], *[q(k) for k in keep])


def _coerced(frame: DataFrame, columns: tuple[ColumnRule, ...]) -> DataFrame:
    """Declared types on an axis; tokens that can't be read end the conversion."""
    values, bad = {}, []
    for c in columns:
        if c.name in frame.columns:
            values[c.name] = COERCE[c.type](q(c.name), field(frame, c.name))
            if "protein_assignment" in c.roles or "fasta_accessions" in c.roles:
                values[c.name] = text.protein_list(q(c.name), c.separator)
            bad.append(F.when(unreadable(q(c.name), values[c.name]), q(c.name).cast("string")).alias(c.name))
    if bad:
        row = frame.select(*bad).agg(*[F.slice(F.array_sort(F.collect_set(q(c.name))), 1, EXAMPLES).alias(c.name) for c in columns if c.name in values]).first()
        wrong = {n: v for n, v in row.asDict().items() if v}
        if wrong:
            raise AxisCoercionError(f"values that can't be read as declared: {some(wrong.items())}")
    return frame.select(*[values[c].alias(c) if c in values else q(c) for c in frame.columns])


def _entries(plan: Plan) -> tuple[sequences.Modification, ...]:
    """The modification map with masses, sites and positions of its accessions."""
    out = []
    for token, accession in plan.rule.modification_map.items():
        known = unimod(accession)
        if known is None:
            raise ColumnComputationError(f"modification map: {accession!r} of token {token!r} is not a known accession")
        out.append(sequences.Modification(token, known.accession, known.mass, known.sites, known.position))
    return tuple(out)


def _normaliser(plan: Plan, column: ColumnRule):
    syntax = plan.rule.sequence_syntax.get(column.syntax, {"parser": "plain_sequence"})
    known = sequences.Tokens(_entries(plan), column.case_sensitive, column.unknown_policy)
    kind = syntax["parser"]
    if kind == "token_regex":
        return sequences.from_tokens(known, syntax["token_pattern"], syntax.get("token_position") == "before_residue", syntax.get("marker_pattern"))
    if kind == "site_list":
        return sequences.from_site_lists(known, syntax.get("delimiter", ";"), syntax.get("site_base", 1))
    if kind == "embedded_site_list":
        return sequences.from_embedded_sites(known, syntax.get("delimiter", ","), syntax["entry_pattern"], syntax.get("site_base", 1), "(?P<count>" in syntax["entry_pattern"])
    return lambda s: (sequences.residues_of(s, s.strip(text.END_MARKS)), [])


def _computed(frame: DataFrame, plan: Plan) -> tuple[DataFrame, dict]:
    """Computed feature columns in declared order."""
    report: dict = {}
    for c in plan.computed:
        own = [q(i) for i in c.inputs]
        syntax = plan.rule.sequence_syntax.get(c.syntax, {"parser": "plain_sequence"})
        if c.how == "proforma_sequence":
            frame, unknown = sequences.with_sequences(frame.drop(c.name), list(c.inputs), c.name, _normaliser(plan, c))
            if unknown:
                report[c.name] = {"unknown_tokens": unknown}
            continue
        if c.how == "stripped_sequence":
            value = text.strip_tokens(own[0], text.java_pattern(syntax["token_pattern"]), syntax.get("marker_pattern")) if syntax["parser"] == "token_regex" else text.plain_sequence(own[0])
            bad = frame.filter(text.not_residues(value)).select(own[0].cast("string").alias("v")).distinct().limit(EXAMPLES).collect()
            if bad:
                raise sequences.UnrecognizedSequenceCharacterError(f"sequences hold characters that are no residues: {some(r[0] for r in bad)}")
        elif c.how == "coalesce":
            value = text.coalesce_text(*own)
        elif c.how == "join_nonempty":
            value = text.join_nonempty(c.separator or ";", *own)
        elif c.how == "proforma_ion":
            value = text.proforma_ion(own[0], own[1])
            bad = frame.filter(own[0].isNotNull() & value.isNull()).select(own[0].alias("s"), own[1].alias("z")).limit(EXAMPLES).collect()
            if bad:
                raise ColumnComputationError(f"{c.name}: charges must be present and positive: {some(tuple(r) for r in bad)}")
        elif c.how == "proforma_fragment":
            value = text.proforma_fragment(own[0], own[1])
        elif c.how in ("decoy", "contaminant"):
            value = text.marker(own[0], equals=c.equals, prefix=c.prefix, separator=c.separator) if own else F.lit(False)
        else:
            value = F.lit(False)
        frame = frame.withColumn(c.name, value)
    return frame, report


def execute(plan: Plan, source: DataFrame, prune: bool = False, staged: bool = True) -> Level:
    """The level of a source frame (physical columns and ``_ord``).

    The cleaned projection is written once as Parquet in the shared folder: the
    checks and results that follow then read columns, not text or joins again, and
    all see the same row order.  ``staged=False`` skips that for sources that are
    columnar and carry their own total order.
    """
    rule, keys = plan.rule, list(plan.raw_keys)
    body = source.select(*[q(c) for c in plan.projection()])
    rows = normalize_missing(source.select(*[q(c) for c in body.columns], F.struct(q(ORDER).alias("o")).alias(ORDER))) if ORDER in source.columns else normalize_missing(body).withColumn(ORDER, F.struct(F.monotonically_increasing_id().alias("o")))
    present = F.lit(False)
    for c in body.columns:
        present = present | q(c).isNotNull()
    rows = rows.filter(present)

    if staged:
        rows = written(rows, "level-source")
    label = rule.fragments.label_output if rule.fragments else None
    names = list(dict.fromkeys([*keys, *[c.name for c in plan.var]]))
    plain_keys = [k for k in keys if k != label]
    if rule.shape == "wide":
        flat = rows.select(*[drop_tokens(q(c.source), c.missing_tokens).alias(c.name) for c in plan.var], *[q(c) for c in dict.fromkeys(x for s in plan.samples.values() for x in s.values())], q(ORDER))
        facts = layout.wide_facts(flat, plain_keys, plan.samples, [x.name for x in plan.layers], ORDER, rule.sample_name)
        obs_keys, obs_payload = [rule.sample_name], []
        features = flat
    else:
        flat = rows.select(*[drop_tokens(q(c.source), c.missing_tokens).alias(f"v:{c.name}") for c in plan.var], *[drop_tokens(q(c.source), c.missing_tokens).alias(f"o:{c.name}") for c in plan.obs], *[q(s).alias(f"l:{n}") for n, s in plan.sources.items()], *([q(plan.label_column).alias("_label")] if plan.label_column else []), q(ORDER))
        obs_keys = [c.name for c in plan.obs if c.name in rule.axis.obs_keys]
        obs_payload = [c.name for c in plan.obs if c.name not in obs_keys]
        ids = [f"v:{k}" for k in plain_keys] + [f"o:{k}" for k in obs_keys]
        if rule.fragments:
            packed = {n: f"l:{n}" for n, s in plan.sources.items() if s in rule.fragments.value_columns}
            checked = {f"l:{n}": rule.fragments.delimiter for n in packed} | ({"_label": rule.fragments.delimiter} if plan.label_column else {})
            layout.require_parallel(flat, checked, [f"v:{k}" for k in plain_keys])
            facts = layout.packed_facts(flat, ids, packed, rule.fragments.delimiter, ORDER, label, "_label" if plan.label_column else None, True)
            facts = facts.select(*[q(f"v:{k}").alias(k) for k in plain_keys], *[q(f"o:{k}").alias(f"o:{k}") for k in obs_keys], q(label), *[q(n) for n in packed], q(ORDER))
        else:
            facts = flat.select(*[q(f"v:{k}").alias(k) for k in plain_keys], *[q(f"o:{k}") for k in obs_keys], *[q(f"l:{n}").alias(n) for n in plan.sources], q(ORDER))
        features = flat.select(*[q(f"v:{c.name}").alias(c.name) for c in plan.var], q(ORDER))
    policies = {c.name: Policy(c.per_feature, rule.rank_rows.by if rule.rank_rows else None, rule.rank_rows.best if rule.rank_rows else "highest") for c in plan.var if c.name not in keys and c.name in names}
    var_raw = axis.build_features(features, plain_keys, policies, ORDER, plan.notation)
    if label:
        labels = facts.groupBy(*[q(k) for k in plain_keys], q(label)).agg(F.min(q(ORDER)).alias("_lo"))
        on = None
        for k in plain_keys:
            same = labels[f"`{k}`"].eqNullSafe(var_raw[f"`{k}`"])
            on = same if on is None else on & same
        var_raw = labels.join(var_raw, on).select(*[labels[f"`{k}`"] for k in plain_keys], labels[label], *[var_raw[f"`{c}`"] for c in var_raw.columns if c not in (*plain_keys, ORDER)], labels["_lo"].alias(ORDER))
    disagree = [c for c in var_raw.columns if c.endswith("?")]
    flags = var_raw.agg(*[F.count_if(q(c)).alias(c[:-1]) for c in disagree]).first().asDict() if disagree else {}

    # raw keys stay beside the typed ones: facts find their row by them
    raw_names = {k: f"_raw_{i}" for i, k in enumerate(keys)}
    typed = _coerced(var_raw.drop(*disagree).select("*", *[q(k).alias(n) for k, n in raw_names.items()]), plan.var)
    final, report = _computed(typed, plan)
    final = axis.complete_keys(final, list(rule.axis.var_keys))
    final = final.persist()
    axis.require_injective(final, list(rule.axis.var_keys))
    var = axis.positions(final, ORDER, VAR).persist()

    if rule.shape == "wide":
        spark = source.sparkSession
        obs = spark.createDataFrame([(s, i) for i, s in enumerate(plan.samples)], f"`{rule.sample_name}` string, {OBS} long")
        obs_join = [rule.sample_name]
        obs_final = obs
    else:
        first = axis.build_axis(flat.select(*[q(f"o:{c}").alias(c) for c in (*obs_keys, *obs_payload)], q(ORDER)), obs_keys, obs_payload, ORDER)
        obs_final = axis.positions(axis.complete_keys(_coerced(first, plan.obs), obs_keys), ORDER, OBS).persist()
        obs_join = obs_keys
        facts = facts.select(*[q(k) for k in keys], *[q(f"o:{k}").alias(k) for k in obs_keys if k not in keys], *[q(x.name) for x in plan.layers if x.name in facts.columns], q(ORDER))

    mapped = axis.to_positions(facts.select(*[q(k).alias(f"_f_{i}") for i, k in enumerate(keys)], *[q(k).alias(f"_s_{i}") for i, k in enumerate(obs_join)], *[q(x.name) for x in plan.layers], q(ORDER)), var.select(*[q(n).alias(f"_f_{i}") for i, n in enumerate(raw_names.values())], VAR), [f"_f_{i}" for i in range(len(keys))], VAR)
    mapped = axis.to_positions(mapped, obs_final.select(*[q(k).cast("string").alias(f"_s_{i}") for i, k in enumerate(obs_join)], OBS), [f"_s_{i}" for i in range(len(obs_join))], OBS)
    mapped = mapped.select(VAR, OBS, *[q(x.name) for x in plan.layers], q(ORDER))

    own = list(plan.layers)
    unread = layers.diagnose(mapped, own)
    masked = layers.mask_absent(mapped, own) if plan.cells.mode != "error" else mapped
    resolved = cells.resolve(masked, [VAR, OBS], [x.name for x in own], plan.cells, ORDER, plan.notation)
    done = layers.parse_layers(resolved, own).drop(ORDER)
    shares = layers.occupancy(done, [x.name for x in own if isinstance(x, layers.NumericLayer)])
    empty = layers.require_filled(shares, rule.measurements.primary_layer)
    pruned: dict[str, str] = {}
    if prune:
        done = done.drop(*empty)
        own = [x for x in own if x.name not in empty]
        removable = [c.name for c in plan.var if c.name not in (*rule.axis.var_keys, *keys) and not c.roles]
        var, pruned = layers.prune(var, removable)
    by_name = {x.name: x for x in rule.measurements.layers}
    infos = {x.name: LayerInfo(x.name, "factor" if isinstance(x, layers.FactorLayer) else x.kind, "measurement", dict(x.categories) if isinstance(x, layers.FactorLayer) else {}, by_name[x.name].roles) for x in own}
    return Level(
        rule.level, obs_final.drop(ORDER), var.drop(ORDER, *raw_names.values()), done, tuple(obs_join), rule.axis.var_keys, infos, rule.measurements.primary_layer,
        {c.name: c.roles for c in (*plan.var, *plan.computed) if c.roles},
        uns={"parse": {"disagreements": flags, "unreadable": unread, "computed": report, "occupancy": shares, "empty_layers": empty, "pruned": pruned, "plan": plan.snapshot()}},
    )
