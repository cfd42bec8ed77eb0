"""Typed settings: strict readers with messages, range checks, precedence of paths, run names, snapshots."""

from __future__ import annotations

import json
import os
import re
from dataclasses import asdict, dataclass, field, fields, is_dataclass
from datetime import datetime
from difflib import get_close_matches


class SettingsError(ValueError):
    """A setting that cannot be used; the message names it and says what to do."""


def unknown_key(key: str, known: set[str], prefix: str = "") -> str:
    near = get_close_matches(key.rsplit(".", 1)[-1], sorted(known), n=1)
    return f"no setting is called '{key}'." + (f" Did you mean '{prefix}{near[0]}'?" if near else "") + f" There are: {', '.join(sorted(known))}."


def _scalar(value, kind: str, label: str):
    if "bool" in kind:
        if isinstance(value, str):
            raise SettingsError(f"{label} is {value!r}, a text, but has to be true or false.")
        return bool(value)
    for name, cast in (("float", float), ("int", int)):
        if name in kind:
            try:
                return cast(value)
            except (TypeError, ValueError):
                raise SettingsError(f"{label} is {value!r}, which is not a number.") from None
    return value


def read(cls: type, data: dict, root: str, prefix: str = ""):
    """An instance of the dataclass ``cls`` from plain data: unknown keys raise with the nearest name, numbers may be
    written as text, ``path`` fields are resolved against ``root``, ``list`` fields must be lists."""
    known = {f.name: f for f in fields(cls)}
    values = {}
    for key, value in data.items():
        label = prefix + str(key)
        if key not in known:
            raise SettingsError(unknown_key(label, set(known), prefix))
        f = known[key]
        kind, section = str(f.type), f.metadata.get("section")
        if section is not None:
            if not isinstance(value, dict):
                raise SettingsError(f"{label} has to be a mapping, not {type(value).__name__}.")
            values[key] = read(section, value, root, f"{label}.")
        elif value is None:
            values[key] = None
        elif f.metadata.get("path"):
            values[key] = anchored(str(value), root)
        elif "tuple" in kind or "list" in kind:
            if isinstance(value, str):
                raise SettingsError(f"{label} has to be a list, not the text {value!r}.")
            values[key] = tuple(map(str, value))
        else:
            values[key] = _scalar(value, kind, label)
    made = cls(**values)
    for f in fields(cls):  # relative defaults are anchored as well
        if f.metadata.get("path") and getattr(made, f.name) is not None:
            setattr(made, f.name, anchored(getattr(made, f.name), root))
    return made


def anchored(path: str, root: str) -> str:
    path = os.path.expanduser(path)
    return os.path.normpath(path if os.path.isabs(path) else os.path.join(root, path))


def _need(good: bool, message: str) -> None:
    if not good:
        raise SettingsError(message)


@dataclass
class Segmenting:
    max_seconds: float = 30.0
    min_seconds: float = 0.5
    top_db: float = 40.0
    min_silence: float = 0.4
    pad_seconds: float = 0.05

    def validate(self) -> None:
        _need(self.max_seconds > self.min_seconds, f"no clip can be longer than min_seconds = {self.min_seconds} and shorter than max_seconds = {self.max_seconds}.")
        _need(self.top_db > 0, f"top_db = {self.top_db} is not below the loudest frame.")
        _need(self.min_silence > 0, f"min_silence = {self.min_silence} is no length of time.")
        _need(self.pad_seconds >= 0, f"pad_seconds = {self.pad_seconds} is below zero.")


@dataclass
class Ending:
    ramp_tokens: int = 0
    ramp_max: float = 1.0
    eos_token_weight: float = 1.0

    def validate(self) -> None:
        _need(self.ramp_tokens >= 0, f"ramp_tokens = {self.ramp_tokens} is below zero.")
        _need(self.ramp_max >= 1 and self.eos_token_weight >= 1, "an ending weighs 1 or more.")


@dataclass
class Training:
    """Settings of a training run: read, checked and kept beside it; the training itself is no part of this package."""

    dataset: str | None = field(default=None, metadata={"path": True})
    val_dataset: str | None = field(default=None, metadata={"path": True})
    output_dir: str = field(default="runs", metadata={"path": True})
    run_name: str | None = None
    voice_name: str = "voice"
    val_split: float = 0.0
    max_length: int = 4096
    epochs: float = 3.0
    batch_size: int = 1
    grad_accum: int = 1
    lr: float = 1.5e-4
    warmup_ratio: float = 0.0
    weight_decay: float = 0.0
    save_strategy: str = "epoch"
    logging_steps: int = 10
    eval_steps: int = 100
    save_steps: int = 500
    bf16: bool = True
    tags: tuple[str, ...] = ()
    ending_weight: Ending = field(default_factory=Ending, metadata={"section": Ending})

    def validate(self, exists=os.path.isfile) -> None:
        _need(self.dataset is not None, "dataset, the corpus to train on, is not set.")
        _need(exists(self.dataset), f"dataset was not found: {self.dataset} (relative paths begin at the settings' own folder).")
        _need(self.val_dataset is None or exists(self.val_dataset), f"val_dataset was not found: {self.val_dataset}.")
        _need(0 <= self.val_split < 1, f"val_split = {self.val_split} is no share of the corpus: 0 for none, below 1.")
        _need(self.max_length >= 16, f"max_length = {self.max_length} is shorter than any example (16 tokens).")
        _need(self.epochs > 0, f"epochs = {self.epochs} is not above zero.")
        for name in ("batch_size", "grad_accum", "logging_steps", "eval_steps", "save_steps"):
            _need(getattr(self, name) >= 1, f"{name} = {getattr(self, name)} is below 1.")
        _need(0 < self.lr < 1, f"lr = {self.lr} is not between 0 and 1.")
        _need(0 <= self.warmup_ratio <= 1, f"warmup_ratio = {self.warmup_ratio} is not between 0 and 1.")
        _need(self.weight_decay >= 0, f"weight_decay = {self.weight_decay} is below zero.")
        _need(self.save_strategy in ("no", "epoch", "steps"), f"save_strategy = {self.save_strategy!r} is none of no, epoch, steps.")
        self.ending_weight.validate()


def snapshot(settings, folder: str) -> str:
    """The settings as they ran, defaults filled in, written as ``config.json`` into ``folder``."""
    assert is_dataclass(settings)
    os.makedirs(folder, exist_ok=True)
    path = os.path.join(folder, "config.json")
    with open(path, "w", encoding="utf-8") as f:
        json.dump(asdict(settings), f, indent=2, ensure_ascii=False)
    return path


_RUN = re.compile(r"ft_(\d+)_")


def run_name(used: list[str], voice: str, now: datetime) -> str:
    """The next number after the runs that are there, the voice and the time."""
    numbers = [int(m[1]) for m in map(_RUN.match, used) if m]
    return f"ft_{max(numbers, default=0) + 1:03d}_{voice}_{now:%Y-%m-%d_%H-%M-%S}"


def parse_aliases(entries: list[str] | None) -> dict[str, str]:
    """``a=b,c=d`` entries to {lower-cased name: voice}; the last of a name wins; an entry of another form raises."""
    out = {}
    for item in (i.strip() for e in entries or () for i in str(e).split(",")):
        name, equals, voice = (p.strip() for p in item.partition("="))
        if item and not (equals and name and voice):
            raise ValueError(f"{item!r} is no alias: one is written name=voice")
        if item:
            out[name.lower()] = voice
    return out


def first_given(explicit: str | None, environment: str | None, default: str, exists=os.path.exists, what: str = "path") -> str:
    """An explicit value, else the environment's, else the default; a local path (it begins with . / or ~) must exist."""
    value = explicit if explicit is not None else environment
    if value is None:
        return default
    if value[:1] in "./~" and not exists(os.path.expanduser(value)):
        raise FileNotFoundError(f"{what} not found at {value}")
    return value


def resolve_name(voice: str | None, known: list[str]) -> str | None:
    """``voice`` if it is known; none stays none; a name that looks like a recording gets a message of its own."""
    from .checks import AUDIO_SUFFIXES

    if voice is None or voice in known:
        return voice
    if os.path.splitext(voice)[1].lower() in AUDIO_SUFFIXES:
        raise LookupError(f"{voice!r} is the name of an audio file, not of a voice: make a voice of it first")
    raise LookupError(f"there is no voice {voice!r}. Available: {', '.join(sorted(known)) or 'none'}.")
