"""Source registry, field mapping and the technique dimension, as data.

All values here are fixed values: names of public datasets and files, the fields that hold their texts, and labels.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class Snapshot:
    output_name: str
    config: str | None = None
    split: str | None = None
    url: str | None = None
    format_label: str | None = None
    options: dict[str, str] = field(default_factory=dict)


@dataclass(frozen=True)
class Source:
    source_name: str
    source_type: str
    origin: str
    snapshots: tuple[Snapshot, ...]
    required: bool = True


HUB, RAW = "huggingface", "github_raw"
TSV = {"sep": "\t", "header": "true", "nullValue": "\0"}

SOURCES = (
    Source("trustairlab", HUB, "TrustAIRLab/in-the-wild-jailbreak-prompts", (
        Snapshot("jailbreak_2023_05_07_train.jsonl", "jailbreak_2023_05_07", "train"), Snapshot("jailbreak_2023_12_25_train.jsonl", "jailbreak_2023_12_25", "train"))),
    Source("rubend18", HUB, "rubend18/ChatGPT-Jailbreak-Prompts", (Snapshot("train.jsonl", None, "train"),)),
    Source("jackhhao", HUB, "jackhhao/jailbreak-classification", (Snapshot("train.jsonl", None, "train"), Snapshot("test.jsonl", None, "test"))),
    Source("harmbench", HUB, "swiss-ai/harmbench", (
        Snapshot("HumanJailbreaks_val.jsonl", "HumanJailbreaks", "val"), Snapshot("HumanJailbreaks_test.jsonl", "HumanJailbreaks", "test"))),
    Source("wildjailbreak", HUB, "allenai/wildjailbreak", (Snapshot("train.jsonl", "train", "train", options=TSV), Snapshot("eval.jsonl", "eval", "train", options=TSV))),
    Source("jailbreakbench_behaviors", HUB, "JailbreakBench/JBB-Behaviors", (Snapshot("behaviors_harmful.jsonl", "behaviors", "harmful"),)),
    Source("advbench", RAW, "llm-attacks/llm-attacks", (
        Snapshot("harmful_behaviors.csv", url="https://raw.githubusercontent.com/llm-attacks/llm-attacks/main/data/advbench/harmful_behaviors.csv", format_label="csv"),)),
    Source("maliciousinstruct", HUB, "walledai/MaliciousInstruct", (Snapshot("train.jsonl", "default", "train"),)),
)

FIELDS = [
    ("trustairlab", "jailbreak_2023_05_07_train.jsonl", "prompt"),
    ("trustairlab", "jailbreak_2023_12_25_train.jsonl", "prompt"),
    ("rubend18", "train.jsonl", "Prompt"),
    ("jackhhao", "train.jsonl", "prompt"),
    ("jackhhao", "test.jsonl", "prompt"),
    ("harmbench", "HumanJailbreaks_val.jsonl", "Behavior"),
    ("harmbench", "HumanJailbreaks_test.jsonl", "Behavior"),
    ("advbench", "harmful_behaviors.csv", "goal"),
    ("jailbreakbench_behaviors", "behaviors_harmful.jsonl", "Goal"),
    ("maliciousinstruct", "train.jsonl", "prompt"),
    ("wildjailbreak", "train.jsonl", "adversarial"),
    ("wildjailbreak", "eval.jsonl", "adversarial"),
]

#: Direct loads, in order: source, file and field, and the key and value that records must have, if any.
LOADS = [
    ("trustairlab", "jailbreak_2023_05_07_train.jsonl", "prompt"),
    ("trustairlab", "jailbreak_2023_12_25_train.jsonl", "prompt"),
    ("rubend18", "train.jsonl", "Prompt"),
    ("jackhhao", "train.jsonl", "prompt", "type", "jailbreak"),
    ("jackhhao", "test.jsonl", "prompt", "type", "jailbreak"),
    ("harmbench", "HumanJailbreaks_val.jsonl", "Behavior"),
    ("harmbench", "HumanJailbreaks_test.jsonl", "Behavior"),
]

UNKNOWN = "Unknown"
TECHNIQUES = [
    ("Persona Hijacking", "psychology_alt"),
    ("Fictional Framing", "movie"),
    ("Authority Impersonation", "admin_panel_settings"),
    ("Token Manipulation", "code"),
    ("Gradual Escalation", "trending_up"),
    ("Hypothetical Distancing", "science"),
    ("Instruction Injection", "edit_note"),
    ("Social Engineering", "sentiment_very_dissatisfied"),
    ("Multi-language Switching", "translate"),
    ("Payload Splitting", "call_split"),
]


def field_mapping(spark: SparkSession, rows: list[tuple[str, str, str]] | None = None) -> DataFrame:
    return spark.createDataFrame(FIELDS if rows is None else rows, "source string, source_file string, field string")


def techniques(spark: SparkSession, rows: list[tuple[str, str]] | None = None) -> DataFrame:
    numbered = [(n, *r) for n, r in enumerate(TECHNIQUES if rows is None else rows)]
    return spark.createDataFrame(numbered, "position int, name string, icon string")


def snapshots(spark: SparkSession) -> DataFrame:
    """One row for each snapshot of the registry."""
    rows = [(s.source_name, s.source_type, s.required, s.origin, x.output_name, x.config, x.split, x.url, x.format_label, x.options) for s in SOURCES for x in s.snapshots]
    return spark.createDataFrame(rows, "source_name string, source_type string, required boolean, origin string, output_name string, config string, split string, url string, format_label string, options map<string,string>")
