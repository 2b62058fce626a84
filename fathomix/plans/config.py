"""Settings: the ranking configuration and where it is read from, embedding profiles, limits, and their checks."""

from __future__ import annotations

import dataclasses
import json
import os
import re
from dataclasses import dataclass, field

from fathomix.operators.ranking import RankingConfig

#: Embedding profiles by name.
PROFILES = {
    "light": {"dimensions": 384, "batch_size": 16, "quantization": "int8"},
    "balanced": {"dimensions": 768, "batch_size": 32, "quantization": "auto"},
    "performance": {"dimensions": 768, "batch_size": 64, "quantization": "fp16"},
}
#: Limits of batches, retries and the breaker, in rows and milliseconds.
LIMITS = {
    "least_batch": 1, "greatest_batch": 256, "batch_reduction": 0.5,
    "retries": 3, "first_delay_ms": 1000, "longest_delay_ms": 30_000,
    "breaker_timeout_ms": 30_000, "breaker_error_share": 0.5, "breaker_reset_ms": 60_000, "breaker_least_calls": 10,
}
#: Least and greatest of the settings of a watcher; sizes in MB, times in ms.
WATCHER_RANGES = {"debounce_ms": (100, 10_000), "batch_size": (1, 1000), "max_queue": (100, 100_000), "memory_mb": (50, 2000), "retries": (0, 10), "retry_delay_ms": (100, 60_000)}
#: The same of a project.
PROJECT_RANGES = {"max_file_bytes": (1, 100 << 20), "batch_size": (1, 1000), "concurrency": (1, 16)}
HOOKS = ("post-commit", "post-merge", "post-checkout", "post-rewrite")


def parse_env(text: str) -> dict[str, str]:
    """NAME=value lines; quotes around a value and an export before a name are dropped, comments are skipped."""
    out = {}
    for line in text.splitlines():
        m = re.match(r"\s*(?:export\s+)?([A-Za-z_]\w*)\s*=\s*(.*?)\s*$", line)
        if m:
            value = m[2]
            quoted = re.match(r"""(["'])(.*)\1(?:\s+#.*)?$""", value)
            out[m[1]] = quoted[2] if quoted else re.sub(r"\s+#.*$", "", value)
    return out


def settings(folder: str, name: str = "config.json", prefix: str = "FATHOMIX_") -> dict:
    """A folder's settings: its JSON file, then its .env file, then the environment, each over the one before."""
    out: dict = {}
    path = os.path.join(folder, name)
    if os.path.exists(path):
        with open(path, encoding="utf-8") as f:
            out = json.load(f)
    env = {}
    if os.path.exists(os.path.join(folder, ".env")):
        with open(os.path.join(folder, ".env"), encoding="utf-8") as f:
            env = parse_env(f.read())
    for k, v in {**env, **os.environ}.items():
        if k.startswith(prefix):
            out[k.removeprefix(prefix).lower()] = v
    return out


class RankingSettings:
    """The ranking configuration of a JSON file, read again whenever the file has changed.

    Without a file the defaults hold; a file that is broken or out of range leaves the last good
    configuration in place and its problem in ``problem``.
    """

    def __init__(self, path: str | None = None):
        self.path, self.problem = path, None
        self._stamp: tuple | None = None
        self._config = RankingConfig()

    def get(self) -> RankingConfig:
        """The configuration as of now; each query asks for it, so no watcher is needed."""
        if self.path is None:
            return self._config
        try:
            s = os.stat(self.path)
        except OSError:
            return self._config
        stamp = (s.st_mtime_ns, s.st_size, s.st_ino)
        if stamp != self._stamp:
            self._stamp = stamp
            try:
                with open(self.path, encoding="utf-8") as f:
                    self._config, self.problem = ranking_of(json.load(f)), None
            except (ValueError, TypeError, AttributeError) as e:
                self.problem = str(e)
        return self._config


def ranking_of(values: dict) -> RankingConfig:
    """A ranking configuration of a dictionary; groups of values may be nested, names not known are an error."""
    flat: dict = {}
    for k, v in values.items():
        flat |= v if isinstance(v, dict) and k != "tie_weights" else {k: v}
    known = {f.name for f in dataclasses.fields(RankingConfig)}
    if set(flat) - known:
        raise ValueError(f"unknown settings: {', '.join(sorted(set(flat) - known))}")
    return RankingConfig(**flat)


def problems(values: dict, ranges: dict[str, tuple[int, int]]) -> list[str]:
    """What is out of range, one text each; values that are not given are fine."""
    out = [f"{k} must be from {low} to {high}" for k, (low, high) in ranges.items() if values.get(k) is not None and not low <= values[k] <= high]
    version = values.get("version")
    if version is not None and not re.fullmatch(r"\d+\.\d+\.\d+(?:[-+][0-9A-Za-z.+-]+)?", str(version)):
        out.append("version must be three numbers with dots")
    return out


@dataclass
class WatcherConfig:
    """How changes of a tree are gathered; checked on creation.  Patterns are added to the usual ones."""

    debounce_ms: int = 500
    batch_size: int = 100
    max_queue: int = 10_000
    memory_mb: int = 500
    retries: int = 3
    retry_delay_ms: int = 1000
    patterns: list[str] = field(default_factory=list)

    def __post_init__(self):
        wrong = problems(dataclasses.asdict(self), WATCHER_RANGES)
        if wrong:
            raise ValueError("; ".join(wrong))


@dataclass
class HookConfig:
    """A hook that tells of changes; it never blocks."""

    name: str
    path: str
    enabled: bool = True
    blocking: bool = False
    timeout_ms: int = 5000

    def __post_init__(self):
        if self.name not in HOOKS:
            raise ValueError(f"name must be one of {', '.join(HOOKS)}")
        if self.blocking:
            raise ValueError("a hook must not block")


@dataclass
class CommitDiff:
    """Changed files (path, status letter) between commits or in the work tree."""

    source: str
    files: list[tuple[str, str]]
    from_commit: str | None = None
    to_commit: str | None = None

    def is_valid(self) -> bool:
        ends = self.source != "commit_range" or bool(self.from_commit and self.to_commit)
        return bool(self.source) and ends and all(p and s for p, s in self.files)

    def frame(self, spark):
        """path and status as a table, for a refresh of these paths only."""
        from pyspark.sql import functions as F

        from fathomix.functions.text import file_status

        rows = spark.createDataFrame(self.files, "path string, letter string")
        return rows.select("path", file_status(F.col("letter")).alias("status"))


def profile(name: str = "light") -> dict:
    """An embedding profile; one that is not known falls back to the lightest, which is told."""
    if name in PROFILES:
        return {"name": name, **PROFILES[name], "fallback": None}
    return {"name": "light", **PROFILES["light"], "fallback": f"no profile {name}"}


def initialise(folder: str) -> dict:
    """Makes an index folder with its settings where there are none; what it made, and what was there."""
    made = []
    for name in ("", "logs"):
        path = os.path.join(folder, name)
        if not os.path.isdir(path):
            os.makedirs(path)
            made.append(path)
    path = os.path.join(folder, "config.json")
    if not os.path.exists(path):
        with open(path, "w", encoding="utf-8") as f:
            json.dump({"version": "1.0.0", "max_file_bytes": 10 << 20, "batch_size": 100, "ranking": {}}, f, indent=2)
        made.append(path)
    return {"folder": folder, "made": made, "problems": problems(settings(folder), PROJECT_RANGES)}
