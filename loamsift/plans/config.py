"""Pipeline configuration: a strict tree with defaults; unknown keys are errors, secrets never leave memory."""

from __future__ import annotations

import hashlib
import json
from typing import Any

from loamsift.operators.generate import EVOL
from loamsift.sources.readers import load_yaml

REQUIRED = object()
OVERRIDE = {"model": None, "base_url": None, "api_key": None, "temperature": None, "max_tokens": None}
SECRETS = {"api_key"}
BLOCKS: dict[str, dict[str, Any]] = {
    "llm": {"provider": REQUIRED, "model": REQUIRED, "api_key": REQUIRED, "base_url": REQUIRED, "timeout_seconds": 30.0, "max_retries": 3, "supports_json_schema": None, "openai_compatible": None},
    "executor": {"mode": "threadpool", "max_workers": 4},
    "data_source": {"type": REQUIRED, "path": None, "chunk_strategy": None, "chunk_size_chars": None, "chunk_overlap_chars": None},
    "generator": {
        "type": REQUIRED, "target_count": 1, "generation_multiplier": 1, "prompt_template": None, "temperature": 0.7, "max_tokens": 512, "input_field": None, "output_field": None,
        "preserve_original": False, "llm_override": None, "rounds": None, "branching_factor": None, "operators": [], "filter": {}, "taxonomy_path": None,
    },
    "embeddings": {"provider": "huggingface", "model": "all-MiniLM-L6-v2", "api_key": None, "base_url": None, "timeout_seconds": None, "max_retries": None, "openai_compatible": None},
    "labeling_engine": {"rubric_path": None, "mode": "single"},
    "output": {"format": REQUIRED, "path": REQUIRED},
}
DEDUP = {"exact": {}, "near": {"shingle_size": 5, "num_hashes": 128, "lsh_bands": 16, "jaccard_threshold": 0.7}}
EVOL_FILTER = {"min_edit_distance_chars": 20, "min_instruction_chars": 20, "refusal_keywords": ["I cannot", "I'm unable", "As an AI"]}
FILTERS = {
    "length": {"min_instruction_chars": 10, "max_instruction_chars": 4096, "min_response_chars": 10, "max_response_chars": 16384}, "language": {"allowed": ["en"]}, "sentence_variance": {"min_cv": 0.15},
    "ifd": {"min_score": 0.2}, "labeling_engine": {"rubric_path": None, "min_overall_score": None}, "reward_model": {"min_score": None, "llm_override": None},
    "pair_delta": {"score_field": "quality", "min_delta": 0.30, "length_ratio_max": None}, "select": {"target_count": None, "weights": {}, "strategy": "top_n"}, "semantic_similarity": {"threshold": 0.9},
    "canary": {"phrases": []}, "double_critic": {"llm_override": None}, "complexity_elo": {"batch_size": 5, "samples_per_record": 4, "k_factor": 32.0, "llm_override": None},
}
CHOICES = {"llm.provider": {"openai"}, "executor.mode": {"threadpool", "realtime", "provider_batch"}, "embeddings.provider": {"huggingface", "openai"}, "labeling_engine.mode": {"single", "multi"}, "output.format": {"jsonl", "chatml", "alpaca"}}


class ConfigError(ValueError):
    def __init__(self, problems: list[str]) -> None:
        super().__init__("; ".join(problems))
        self.problems = problems


def _block(name: str, given: Any, known: dict[str, Any], problems: list[str]) -> dict[str, Any]:
    if not isinstance(given, dict):
        problems.append(f"{name}: must be a mapping")
        return {}
    problems += [f"{name}.{k}: unknown key" for k in given if k not in known]
    out = {}
    for k, default in known.items():
        if k in given:
            out[k] = given[k]
        elif default is REQUIRED:
            problems.append(f"{name}.{k}: required")
        else:
            out[k] = default.copy() if isinstance(default, (dict, list)) else default
        if f"{name}.{k}" in CHOICES and k in out and out[k] not in CHOICES[f"{name}.{k}"]:
            problems.append(f"{name}.{k}: must be one of {sorted(CHOICES[f'{name}.{k}'])}")
    return out


def resolve(data: dict[str, Any]) -> dict[str, Any]:
    """The configuration with all defaults, or a ConfigError that lists every problem."""
    problems: list[str] = []
    top = {"version", "run_id", "dedup", "filters", *BLOCKS}
    problems += [f"{k}: unknown key" for k in data if k not in top]
    if "version" not in data:
        problems.append("version: required")
    out: dict[str, Any] = {"version": str(data.get("version")), "run_id": data.get("run_id")}
    for name, known in BLOCKS.items():
        required = any(v is REQUIRED for v in known.values()) or name == "executor"
        if name not in data and required:
            problems.append(f"{name}: required")
        out[name] = _block(name, data.get(name, {}), known, problems) if name in data or not required else {}
    dedup = data.get("dedup", [])
    if not isinstance(dedup, list):
        problems.append("dedup: must be a list")
        dedup = []
    out["dedup"] = _stages("dedup", dedup, DEDUP, problems)
    filters = data.get("filters")
    if not isinstance(filters, dict) or "target_count" not in filters:
        problems.append("filters.target_count: required")
        filters = filters if isinstance(filters, dict) else {}
    problems += [f"filters.{k}: unknown key" for k in filters if k not in ("target_count", "stages")]
    out["filters"] = {"target_count": filters.get("target_count"), "stages": _stages("filters.stages", filters.get("stages", []), FILTERS, problems)}
    _check(out, problems)
    if problems:
        raise ConfigError(problems)
    return out


def _stages(name: str, given: list, known: dict[str, dict], problems: list[str]) -> list[dict[str, Any]]:
    out = []
    for i, s in enumerate(given):
        kind = s.get("type") if isinstance(s, dict) else None
        if kind not in known:
            problems.append(f"{name}[{i}].type: must be one of {sorted(known)}")
            continue
        rest = {k: v for k, v in s.items() if k != "type"}
        block = _block(f"{name}[{i}]", rest, known[kind], problems)
        if isinstance(block.get("llm_override"), dict):
            _block(f"{name}[{i}].llm_override", block["llm_override"], OVERRIDE, problems)
        out.append({"type": kind, **block})
    return out


def _check(c: dict[str, Any], problems: list[str]) -> None:
    d, g = c["data_source"], c["generator"]
    if d.get("type") == "pdf":
        if not d["path"]:
            problems.append("data_source.path: required for pdf")
        for k, v in (("chunk_strategy", "fixed"), ("chunk_size_chars", 3000), ("chunk_overlap_chars", 300)):
            d[k] = v if d[k] is None else d[k]
        if not 0 <= d["chunk_overlap_chars"] < d["chunk_size_chars"]:
            problems.append("data_source.chunk_overlap_chars: must be at least 0 and below chunk_size_chars")
    if isinstance(g.get("llm_override"), dict):
        _block("generator.llm_override", g["llm_override"], OVERRIDE, problems)
    if "filter" in g:
        g["filter"] = _block("generator.filter", g["filter"], EVOL_FILTER, problems)
    need = {"transform": ("input_field", "output_field"), "taxonomy_prompt": ("taxonomy_path",), "evol_instruct": ("rounds", "branching_factor", "operators")}
    for k in need.get(g.get("type"), ()):
        if not g.get(k):
            problems.append(f"generator.{k}: required for {g['type']}")
    if g.get("type") == "evol_instruct":
        problems += [f"generator.operators: no such operator {o}" for o in sorted(set(g.get("operators") or []) - set(EVOL))]
    for i, s in enumerate(c["dedup"]):
        if s["type"] == "near" and not 1 <= s["lsh_bands"] <= s["num_hashes"]:
            problems.append(f"dedup[{i}].lsh_bands: must be between 1 and num_hashes")


def load(path: str, env: dict[str, str] | None = None) -> dict[str, Any]:
    return resolve(load_yaml(path, env))


def without_secrets(value: Any) -> Any:
    if isinstance(value, dict):
        return {k: without_secrets(v) for k, v in value.items() if k not in SECRETS}
    return [without_secrets(v) for v in value] if isinstance(value, list) else value


def config_hash(config: dict[str, Any]) -> str:
    return hashlib.sha256(json.dumps(without_secrets(config), sort_keys=True, default=str).encode()).hexdigest()
