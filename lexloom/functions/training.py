"""What can be told of a model from its name: parameters, memory, target modules; and training settings by task."""

from __future__ import annotations

import json
import re
from functools import reduce
from pathlib import Path

from pyspark.sql import Column
from pyspark.sql import functions as F

GB = 1024**3
# fixed values: settings by task, bytes a parameter and GB of overhead by method, memory of cards
#: task: (epochs, longest sequence)
TASKS = {"general": (3, 2048), "contract_review": (5, 4096), "case_analysis": (3, 4096), "legal_qa": (3, 2048), "summarisation": (3, 4096), "citation_extraction": (5, 1024)}
METHODS = {"qlora": (0.5, 2.0), "lora": (2.0, 4.0), "full": (16.0, 0.0)}
GPUS = ((8, "RTX 3070/4070 (8GB) or better"), (12, "RTX 3080/4080 (12GB) or better"), (16, "RTX 4080 Super (16GB) or V100"), (24, "RTX 3090/4090 (24GB) or A10"), (48, "A40/A6000 (48GB)"), (80, "A100/H100 (80GB)"))


def parameters(model: Column) -> Column:
    """Parameters by the size in the name, experts times size; null without one."""
    form, low = r"(?<![\d.])(?:(\d+)x)?(\d+(?:\.\d+)?)b(?![a-z])", F.lower(model)
    experts, billions = F.regexp_extract(low, form, 1), F.regexp_extract(low, form, 2)
    return F.when(billions != "", (F.when(experts != "", experts.cast("int")).otherwise(1) * billions.cast("double") * 1_000_000_000).cast("long"))


def memory(model: Column, method: str = "qlora", batch: int = 4, longest: int = 2048) -> Column:
    """struct<model_memory_gb, training_overhead_gb, activation_memory_gb, total_gb, recommended_gpu>, unrounded; null without a size."""
    each, overhead = METHODS.get(method, METHODS["full"])
    own, active = parameters(model) * each / GB, F.lit(batch * longest * 4096 * 4 / GB)
    total = own + overhead + active
    gpu = F.lit("Multiple GPUs required")
    for most, name in reversed(GPUS):
        gpu = F.when(total <= most, F.lit(name)).otherwise(gpu)
    return F.when(parameters(model).isNotNull(), F.struct(own.alias("model_memory_gb"), F.lit(overhead).alias("training_overhead_gb"), active.alias("activation_memory_gb"), total.alias("total_gb"), gpu.alias("recommended_gpu")))


# fixed values: modules to adapt, by a pattern of the model's name
_BLOCKS = ["query_key_value", "dense", "dense_h_to_4h", "dense_4h_to_h"]
MODULES = [
    ("gemma|llama|mistral|mixtral|qwen|smollm|yi-", ["q_proj", "k_proj", "v_proj", "o_proj", "gate_proj", "up_proj", "down_proj"]), ("phi-?[34]", ["qkv_proj", "o_proj", "gate_up_proj", "down_proj"]),
    ("falcon", _BLOCKS), ("mpt", ["Wqkv", "out_proj", "up_proj", "down_proj"]), ("neox|pythia", _BLOCKS), ("gpt2", ["c_attn", "c_proj", "c_fc"]),
]
ALL_MODULES = "all-linear"


def modules_of(model: str) -> list[str] | str:
    return next((list(m) for pattern, m in MODULES if re.search(pattern, model.lower())), ALL_MODULES)


def target_modules(model: Column) -> Column:
    """array<string> of the modules to adapt; ['all-linear'] for models not known."""
    names = lambda xs: F.array(*[F.lit(x) for x in xs])
    return reduce(lambda rest, row: F.when(F.lower(model).rlike(row[0]), names(row[1])).otherwise(rest), reversed(MODULES), names([ALL_MODULES]))


# fixed values: settings of a training run
SETTINGS = {
    "base_model": "mistralai/Mistral-7B-v0.1", "method": "qlora", "task": "general", "jurisdiction": "uk", "learning_rate": 2e-4, "num_epochs": None, "batch_size": 4, "gradient_accumulation_steps": 4,
    "max_seq_length": None, "warmup_ratio": 0.03, "weight_decay": 0.01, "lora_r": 64, "lora_alpha": 128, "lora_dropout": 0.05, "lora_target_modules": None, "use_4bit": None,
    "bnb_4bit_compute_dtype": None, "bnb_4bit_quant_type": "nf4", "use_nested_quant": False, "fp16": False, "bf16": True, "gradient_checkpointing": True, "max_grad_norm": 0.3,
    "output_dir": "./legal-llm-output", "save_steps": 100, "logging_steps": 10, "eval_steps": 100, "save_total_limit": 3, "train_dataset": None, "eval_dataset": None, "text_column": "text",
    "prompt_template": "alpaca", "push_to_hub": False, "hub_model_id": None, "hub_token": None, "hub_private_repo": True, "seed": 42, "optim": None, "lr_scheduler_type": "cosine", "report_to": "none",
    "trust_remote_code": False, "preserve_citations": True, "anonymise_training_data": False,
}
ALL_TASKS = ["general", "contract_review", "case_analysis", "legal_qa", "document_drafting", "citation_extraction", "summarisation", "clause_classification"]
DERIVED_BY = ("task", "method", "base_model", "bf16")
LORA_ONLY = ("lora_r", "lora_dropout")
LIMITS = [
    *((n, lambda v: v >= 1, "at least 1") for n in ("num_epochs", "batch_size", "gradient_accumulation_steps", "max_seq_length", "lora_r")),
    ("learning_rate", lambda v: v > 0, "positive"), ("warmup_ratio", lambda v: 0 <= v < 1, "in [0, 1)"), ("lora_dropout", lambda v: 0 <= v < 1, "in [0, 1)"),
]


class TrainingConfig:
    """Settings of a run. Those not given follow from the task, the method and the model, and are derived anew when a saved file is used with others."""

    def __init__(self, **given):
        if unknown := set(given) - set(SETTINGS):
            raise ValueError(f"unknown settings: {', '.join(sorted(unknown))}")
        values = SETTINGS | given
        for name in ("method", "jurisdiction"):
            values[name] = values[name].lower()
        for name, known in (("method", METHODS), ("task", ALL_TASKS), ("jurisdiction", ("uk", "us", "eu"))):
            if values[name] not in known:
                raise ValueError(f"unknown {name} {values[name]!r}: one of {', '.join(known)}")
        if values["use_4bit"] and values["method"] != "qlora":
            raise ValueError("4-bit loading goes with the method qlora")
        if values["fp16"] and values["bf16"]:
            raise ValueError("at most one of fp16 and bf16")
        derived = self.derived_from(**{k: values[k] for k in DERIVED_BY})
        self.derived = tuple(k for k in derived if values[k] is None)
        self.values = values | {k: derived[k] for k in self.derived}
        for name, holds, said in LIMITS:
            if (name not in LORA_ONLY or self.values["method"] != "full") and not holds(self.values[name]):
                raise ValueError(f"{name} must be {said}")

    @staticmethod
    def derived_from(task: str, method: str, base_model: str, bf16: bool) -> dict:
        epochs, longest = TASKS.get(task, TASKS["general"])
        return {
            "num_epochs": epochs, "max_seq_length": longest, "use_4bit": method == "qlora", "bnb_4bit_compute_dtype": "bfloat16" if bf16 else "float16",
            "optim": "paged_adamw_32bit" if method == "qlora" else "adamw_torch", "lora_target_modules": modules_of(base_model),
        }

    def __getattr__(self, name: str):
        if name != "values" and name in self.__dict__.get("values", {}):
            return self.values[name]
        raise AttributeError(name)

    def __eq__(self, other) -> bool:
        return isinstance(other, TrainingConfig) and self.values == other.values

    def __repr__(self) -> str:
        return f"TrainingConfig({', '.join(f'{k}={v!r}' for k, v in self.values.items() if k != 'hub_token')})"

    def to_dict(self) -> dict:
        """All settings but the hub's token, with the names of the derived ones and what they were derived from."""
        return {k: v for k, v in self.values.items() if k != "hub_token"} | {"derived_settings": list(self.derived), "derived_from": {k: self.values[k] for k in DERIVED_BY}}

    @classmethod
    def explicit(cls, record: dict) -> dict:
        """The settings of a saved record that were chosen: those not derived, and derived ones that were edited since."""
        known = {k: v for k, v in record.items() if k in SETTINGS}
        listed = set(record.get("derived_settings", ()))
        base = cls.derived_from(**{k: record["derived_from"].get(k, known.get(k, SETTINGS[k])) for k in DERIVED_BY}) if "derived_from" in record else None
        return {k: v for k, v in known.items() if k not in listed or base is not None and v != base[k]}

    @classmethod
    def from_dict(cls, record: dict) -> TrainingConfig:
        """Unknown names are left out."""
        return cls(**cls.explicit(record))

    def save(self, path: str) -> None:
        Path(path).parent.mkdir(parents=True, exist_ok=True)
        Path(path).write_text(json.dumps(self.to_dict(), indent=2), encoding="utf-8")

    @classmethod
    def load(cls, path: str) -> TrainingConfig:
        return cls.from_dict(json.loads(Path(path).read_text(encoding="utf-8")))

    @classmethod
    def of_task(cls, task: str, **given) -> TrainingConfig:
        """The settings usual for a task."""
        return cls(**{"task": task, **given})
