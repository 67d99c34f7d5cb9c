"""Iterative taxonomy discovery: samples by Spark, a small tree of categories on the driver, a provider for proposals.

The tree has at most 8 categories of at most 5 subtechniques, so it is plain data. What a provider proposes is
checked against the samples it was shown: only ids of known samples count as support.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field, replace
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusmill.operators import sampling
from corpusmill.sources import publish

ROUNDS, STREAK = 4, 2
MOST_CATEGORIES, MOST_SUBTECHNIQUES, MOST_IDS, MOST_EXCERPTS = 8, 5, 8, 3
#: Bounds of a proposal: ids, traits, subtechniques, matches, new categories, open questions.
BOUNDS = {"ids": 8, "traits": 6, "subtechniques": 5, "matches": 8, "new": 2, "questions": 3}


class ProposalError(ValueError):
    """A proposal that breaks the contract."""


def distinct(items: Iterable[str]) -> list[str]:
    return list(dict.fromkeys(items))


def key(name: str) -> str:
    return " ".join(name.lower().split())


def texts(value: object) -> list[str]:
    """The strings of a list, stripped, without blanks and repeats; nothing of anything else."""
    return distinct(x.strip() for x in value if isinstance(x, str) and x.strip()) if isinstance(value, list) else []


def text(value: object) -> str:
    return value.strip() if isinstance(value, str) else ""


@dataclass(frozen=True)
class Node:
    """A category or a subtechnique. own: ids cited for the node itself; ids: those and its children's."""

    name: str
    description: str
    traits: list[str] = field(default_factory=list)
    own: list[str] = field(default_factory=list)
    children: list[Node] = field(default_factory=list)

    @property
    def ids(self) -> list[str]:
        return distinct([*self.own, *(i for c in self.children for i in c.ids)])[:MOST_IDS]

    @property
    def weight(self) -> tuple[int, str]:
        return len(self.ids), self.name.lower()

    def settled(self) -> Node:
        """With children in order of support and name, both descending, and cut; the ids are those before the cut."""
        return replace(self, own=self.own, children=sorted(self.children, key=lambda c: c.weight, reverse=True)[:MOST_SUBTECHNIQUES])


def cited(value: object, samples: dict[str, dict]) -> list[str]:
    return distinct(x for x in value if isinstance(x, str) and x in samples)[:MOST_IDS] if isinstance(value, list) else []


def subtechniques(value: object, samples: dict[str, dict]) -> list[Node]:
    """Proposed subtechniques that have a name, a description and a known sample."""
    found = []
    for p in value if isinstance(value, list) else []:
        if isinstance(p, dict):
            node = Node(text(p.get("name")), text(p.get("description")), texts(p.get("distinguishing_traits")), cited(p.get("supporting_sample_ids"), samples))
            if node.name and node.description and node.own:
                found.append(node)
    return found


def category(proposal: dict, samples: dict[str, dict]) -> Node | None:
    """A proposed category, unless it lacks a name, a description or any support."""
    children = subtechniques(proposal.get("subtechniques"), samples)[:MOST_SUBTECHNIQUES]
    node = Node(text(proposal.get("name")), text(proposal.get("description")), texts(proposal.get("distinguishing_traits")), cited(proposal.get("supporting_sample_ids"), samples), children)
    return node.settled() if node.name and node.description and (node.own or children) else None


def merge(old: Node, ids: list[str], traits: list[str], more: list[Node]) -> Node:
    """old with further ids, traits and subtechniques; those of one name are one."""
    children = {key(c.name): c for c in old.children}
    for c in more:
        k = key(c.name)
        have = children.get(k)
        children[k] = replace(have, own=distinct([*have.own, *c.own])[:MOST_IDS], traits=distinct([*have.traits, *c.traits])) if have else c
    return replace(old, own=distinct([*old.own, *ids])[:MOST_IDS], traits=distinct([*old.traits, *traits]), children=list(children.values())).settled()


def match(old: Node, proposal: dict, samples: dict[str, dict]) -> tuple[Node, int]:
    """old with what a match cites, and by how many ids its support grew."""
    ids = proposal.get("supporting_sample_ids")
    ids = [x for x in ids if isinstance(x, str) and x in samples] if isinstance(ids, list) else []
    new = merge(old, ids, texts(proposal.get("refined_traits")), subtechniques(proposal.get("subtechniques"), samples))
    return new, max(len(new.ids) - len(old.ids), 0)


def check(proposal: dict) -> dict:
    """A round's proposal, if it keeps to the bounds."""

    def within(items: object, kind: str) -> list:
        if not isinstance(items, list) or len(items) > BOUNDS[kind]:
            raise ProposalError(f"{kind}: at most {BOUNDS[kind]} are allowed")
        return items

    within(proposal.get("open_questions", []), "questions")
    for group, kind in (("existing_top_level_matches", "matches"), ("new_top_level_categories", "new")):
        for p in within(proposal.get(group, []), kind):
            for node in [p, *within(p.get("subtechniques", []), "subtechniques")]:
                within(node.get("supporting_sample_ids", []), "ids")
                within(node.get("distinguishing_traits", node.get("refined_traits", [])), "traits")
    return proposal


def support(node: Node, samples: dict[str, dict]) -> dict:
    cited_ = [samples[i] for i in node.ids]
    shown = ("sample_id", "prompt_id", "source", "source_file", "source_row", "excerpt")
    return {
        "name": node.name, "description": node.description, "distinguishing_traits": node.traits, "supporting_sample_ids": node.ids,
        "supporting_prompt_ids": [s["prompt_id"] for s in cited_], "support_count": len(cited_),
        "source_distribution": dict(sorted(Counter(s["source"] for s in cited_).items())), "representative_excerpts": [{k: s[k] for k in shown} for s in cited_[:MOST_EXCERPTS]],
    }


def serialize(node: Node, samples: dict[str, dict]) -> dict:
    return {**support(node, samples), "subtechniques": [support(c, samples) for c in node.children]}


def payload(samples: list[dict], categories: list[Node]) -> str:
    """What a provider is shown of a round: the taxonomy so far and the samples, a line each."""
    lines = [f"samples: {len(samples)}", *(f"source {s}: {n}" for s, n in sorted(Counter(x["source"] for x in samples).items()))]
    for c in categories:
        lines.append(f"category {c.name}: {c.description} | {'; '.join(c.traits[:4])} | {'; '.join(x.name for x in c.children[:5])}")
    lines += [f"[{s['sample_id']}] {s['source']} {s['prompt_length_bucket']}: {s['excerpt']}" for s in samples]
    return "\n".join(lines)


def estimated_tokens(text_: str) -> int:
    """A rough count of a model's tokens: one for four characters."""
    return -(-len(text_) // 4)


def discover(records: DataFrame, propose: Callable[[str, int], dict], rounds: int = ROUNDS, budget: int = sampling.BUDGET, debug: str | None = None) -> dict:
    """Rounds of sampling and proposals until nothing is unseen, or STREAK rounds in a row bring no new category.

    A proposal may have `usage` with input_tokens and output_tokens, which are summed up, as are the estimates of what
    is shown. One that is out of bounds fails the run, after a report of it below debug, if that is given.

    A round's sample, at most `budget` rows, is the only thing collected. Ids seen so far go back to Spark as a table.
    """
    spark = records.sparkSession
    samples: dict[str, dict] = {}
    tree: dict[str, Node] = {}
    history, questions, streak, tokens = [], [], 0, {"estimated_input": 0, "input": 0, "output": 0}
    for number in range(1, rounds + 1):
        seen = spark.createDataFrame([(s["prompt_id"],) for s in samples.values()], "prompt_id string") if samples else None
        shown = [r.asDict() for r in sampling.select_round(records, seen, number, budget).collect()]
        if not shown:
            break
        now = {s["sample_id"]: s for s in shown}
        samples |= now
        asked = payload(shown, list(tree.values()))
        raw = propose(asked, number)
        used = raw.get("usage") or {}
        tokens = {"estimated_input": tokens["estimated_input"] + estimated_tokens(asked), **{k: tokens[k] + int(used.get(f"{k}_tokens") or 0) for k in ("input", "output")}}
        try:
            proposal = check(raw)
        except ProposalError as error:
            if debug:
                publish.report(spark, f"{debug}/round_{number:02d}.json", {"iteration": number, "error": str(error), "estimated_input_tokens": estimated_tokens(asked), "usage": used, "raw_response": raw})
            raise
        questions += texts(proposal.get("open_questions"))
        growth, before, matched, names = 0, len(tree), [], []
        for p in proposal.get("existing_top_level_matches", []):
            if (k := key(text(p.get("top_level_name")))) in tree:
                tree[k], more = match(tree[k], p, samples)
                growth += more
                matched.append(tree[k].name)
        for p in proposal.get("new_top_level_categories", []):
            if node := category(p, now):
                k = key(node.name)
                names += [node.name] if k not in tree else []
                tree[k] = merge(tree[k], node.own, node.traits, node.children) if k in tree else node
        tree = {key(c.name): c for c in sorted(tree.values(), key=lambda c: c.weight, reverse=True)[:MOST_CATEGORIES]}
        streak = 0 if names else streak + 1
        count = lambda of: dict(sorted(Counter(map(of, shown)).items()))
        history.append({
            "round": number, "requested": budget, "samples": len(shown), "analyzed": len(samples), "sources": count(lambda x: x["source"]), "strata": count(lambda x: x["stratification_signature"]),
            "categories_before": before, "matched": distinct(matched), "new_names": names, "new_categories": len(names), "evidence_growth": growth, "streak": streak,
            "tokens": {"estimated_input": estimated_tokens(asked), **{k: int(used.get(f"{k}_tokens") or 0) for k in ("input", "output")}, "stop_reason": used.get("stop_reason")},
        })
        if streak >= STREAK:
            break
    if not tree:
        raise ProposalError("no category was found")
    return {"version": 4, "rounds": history, "most_rounds": rounds, "open_questions": distinct(questions), "tokens": tokens, "categories": [serialize(c, samples) for c in tree.values()]}


def report(records: DataFrame, found: dict, path: str, to: str) -> dict:
    """The report, version 4, of what discover() has found in the records of a path; it replaces the one at `to`."""
    counts = {r["source"]: r["count"] for r in records.groupBy("source").count().orderBy("source").collect()}  # a row for each source
    history, tokens = found["rounds"], found["tokens"]
    streak = history[-1]["streak"] if history else 0
    reason = "no_meaningful_new_categories_for_consecutive_rounds" if streak >= STREAK else "max_iterations_reached" if len(history) == found["most_rounds"] else "no_unseen_records_remaining"
    rounds = [
        {
            "iteration": r["round"], "requested_round_sample_size": r["requested"], "round_sample_count": r["samples"], "cumulative_analyzed_sample_count": r["analyzed"],
            # Quotas are within what a source has, so they are met.
            "target_source_allocations": r["sources"], "round_source_counts": r["sources"], "round_stratum_counts": r["strata"], "existing_top_level_categories_before_round": r["categories_before"],
            "existing_top_level_matches": r["matched"], "new_top_level_category_names": r["new_names"], "valid_new_top_level_category_count": r["new_categories"], "evidence_added_to_existing_top_levels": r["evidence_growth"],
            "llm_usage": {"estimated_input_tokens": r["tokens"]["estimated_input"], "actual_input_tokens": r["tokens"]["input"], "actual_output_tokens": r["tokens"]["output"], "stop_reason": r["tokens"]["stop_reason"]},
        }
        for r in history
    ]
    made = {
        "generated_at": datetime.now(UTC).isoformat(), "normalized_path": path, "proposed_taxonomy_path": to, "report_version": 4, "human_review_required": True,
        "sampling_strategy": {
            "seed": sampling.SEED, "strata": ["source", "source_file", "prompt_length_bucket"], "round_sample_size": sampling.BUDGET, "min_samples_per_source_per_round": sampling.LEAST,
            "max_source_share_per_round": sampling.LARGEST_SHARE, "excerpt_max_chars": 180,
        },
        "saturation_status": {"reached": reason != "max_iterations_reached", "reason": reason, "completed_iterations": len(history), "max_iterations": found["most_rounds"], "consecutive_no_new_category_rounds": streak, "threshold": STREAK},
        "iterations": rounds, "top_level_categories": found["categories"], "analyzed_sample_count": history[-1]["analyzed"] if history else 0, "total_normalized_records": sum(counts.values()), "source_record_counts": counts,
        "token_usage": {"estimated_total_input_tokens": tokens["estimated_input"] or None, "actual_total_input_tokens": tokens["input"], "actual_total_output_tokens": tokens["output"]},
        "analysis_constraints": {"normalized_data_modified": False, "classified_artifacts_created": False, "full_corpus_classification_performed": False, "numeric_support_counts_are_code_computed": True},
        "open_questions": found["open_questions"],
    }
    publish.report(records.sparkSession, to, made)
    return made


def saturation(rounds: DataFrame) -> DataFrame:
    """rounds (round, samples, new_categories) with the running number of samples and the streak without news."""
    running = Window.orderBy("round").rowsBetween(Window.unboundedPreceding, 0)
    last = F.coalesce(F.max(F.when(F.col("new_categories") > 0, F.col("round"))).over(running), F.lit(0))
    return rounds.select("round", F.sum("samples").over(running).alias("analyzed"), (F.col("round") - last).cast("long").alias("streak"))


def replay(rounds: list[dict]) -> Callable[[str, int], dict]:
    """A provider that gives recorded proposals."""
    return lambda shown, number: rounds[number - 1] if number <= len(rounds) else {}


def evidence(cited_ids: DataFrame, samples: DataFrame, limit: int = MOST_IDS) -> DataFrame:
    """Support of categories from (category, position, sample_id): known ids in order without repeats, cut to limit."""
    known = cited_ids.join(samples.select("sample_id", "source"), "sample_id")
    first = known.groupBy("category", "sample_id", "source").agg(F.min("position").alias("position"))
    place = F.row_number().over(Window.partitionBy("category").orderBy("position"))
    kept = first.withColumn("place", place).where(F.col("place") <= limit)
    by_source = kept.groupBy("category", "source").agg(F.count(F.lit(1)).alias("n"), F.collect_list(F.struct("place", "sample_id")).alias("ids"))
    merged = by_source.groupBy("category").agg(F.sort_array(F.flatten(F.collect_list("ids"))).alias("ids"), F.sort_array(F.collect_list(F.struct("source", "n"))).alias("sources"), F.sum("n").alias("support_count"))
    return merged.select("category", F.transform("ids", lambda x: x["sample_id"]).alias("supporting_sample_ids"), "sources", "support_count")


def empty(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], "round bigint, samples bigint, new_categories bigint")
