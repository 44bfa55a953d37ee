"""Settings from the environment, and the session."""

from __future__ import annotations

import logging
import os
import shlex
import sys
from dataclasses import dataclass
from pathlib import Path
from urllib.parse import unquote, urlparse

from pyspark.sql import SparkSession


def env_bool(name: str, default: bool, env: dict[str, str] | None = None) -> bool:
    """1, true, yes and on are true, whatever their case."""
    value = (os.environ if env is None else env).get(name)
    return default if value is None else value.strip().lower() in {"1", "true", "yes", "on"}


def env_file(path: str | Path = ".env") -> dict[str, str]:
    """NAME=value lines of a file, quotes and comments removed; nothing if there is no file."""
    path, out = Path(path), {}
    for line in path.read_text("utf-8").splitlines() if path.is_file() else ():
        name, equals, value = line.strip().removeprefix("export ").partition("=")
        if equals and not name.startswith("#"):
            value = value.strip()
            out[name.strip()] = value[1:-1] if len(value) > 1 and value[0] == value[-1] and value[0] in "\"'" else value.split(" #")[0].strip()
    return out


def logger(path: str | Path | None = None, name: str = "leafwork") -> logging.Logger:
    """The driver's logger, to standard output and a file; handlers of an earlier run are taken off."""
    log = logging.getLogger(name)
    log.setLevel(logging.INFO)
    for h in list(log.handlers):
        log.removeHandler(h)
        h.close()
    for h in [logging.StreamHandler(sys.stdout), *([] if path is None else [logging.FileHandler(path, encoding="utf-8")])]:
        h.setFormatter(logging.Formatter("%(asctime)s %(levelname)s %(message)s"))
        log.addHandler(h)
    return log


def default_output_dir(env: dict[str, str] | None = None, home: Path | None = None) -> Path:
    """OUTPUT_DIR, else a desktop folder that exists, else ``outputs``."""
    env, home = os.environ if env is None else env, home or Path.home()
    if env.get("OUTPUT_DIR"):
        return Path(env["OUTPUT_DIR"]).expanduser()
    return next((d for d in (home / "Desktop", home / "桌面") if d.is_dir()), Path("outputs"))


def input_path(typed: str) -> str:
    """A path as typed, dragged or given as a file URI."""
    typed = typed.strip()
    if typed.startswith("file://"):
        uri = urlparse(typed)
        return (f"//{uri.netloc}" if uri.netloc not in ("", "localhost") else "") + unquote(uri.path)
    try:
        words = shlex.split(typed)
    except ValueError:
        words = []
    return words[0] if words else typed.strip("\"'")


@dataclass(frozen=True)
class Settings:
    """Options of a run.

    ``callers`` tasks call a model, each with ``in_flight`` calls at a time; ``replies`` is a shared folder that remembers what it
    said.  ``sources`` and ``crops`` ask for copies of the input files and of the figures' pixels beside the reports.  A job that reports
    nothing for ``silence`` seconds counts as failed.
    """

    model: str = ""
    timeout: int = 60
    attempts: int = 3
    stream: bool = True
    max_output_tokens: int = 8192
    render_zoom: float = 2.5
    max_chars: int = 70_000
    batch_items: int = 6
    batch_chars: int = 6000
    callers: int = 2
    in_flight: int = 4
    replies: str = ""
    image_format: str = "png"
    compress_images: bool = True
    silence: int = 600
    sources: bool = False
    crops: bool = False
    markdown: bool = True
    summary: bool = True
    html: bool = False
    json: bool = False
    xlsx: bool = False
    extract: bool = False

    @classmethod
    def from_env(cls, env: dict[str, str] | None = None, path: str | Path = ".env") -> Settings:
        """Each option from LEAFWORK_<NAME> where that is set, in the environment or else in a file."""
        env = env_file(path) | dict(os.environ) if env is None else env
        found = {}
        for name, field in cls.__dataclass_fields__.items():
            key = f"LEAFWORK_{name.upper()}"
            if key in env:
                kind = type(field.default)
                found[name] = env_bool(key, field.default, env) if kind is bool else kind(env[key])
        return cls(**found)

    @property
    def mime(self) -> str:
        return "image/jpeg" if self.image_format in ("jpg", "jpeg") else "image/png"

    @property
    def extracts(self) -> bool:
        """JSON and spreadsheets need the fact tables."""
        return self.extract or self.json or self.xlsx


def session(name: str = "leafwork", **conf: str) -> SparkSession:
    """A session in UTC with adaptive execution; other settings are the cluster's."""
    return SparkSession.builder.appName(name).config(map={"spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true"} | conf).getOrCreate()
