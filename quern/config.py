"""Settings: defaults, then a JSON file, then the environment; validated. They live on the driver."""

from __future__ import annotations

import copy
import dataclasses
import json
import os
from dataclasses import dataclass, field
from pathlib import Path

from quern.errors import ConfigError

FOLDER, FILE = ".index", "config.json"


@dataclass
class Embedding:
    dimensions: int = 256
    max_embed_chars: int = 20000
    model: str = "feature-hash"
    provider: str = "hash"
    trust_remote_code: bool = False
    device: str | None = None
    document_prefix: str = ""
    batch_size: int = 50
    retry_delay_seconds: float = 1.0
    api_key: str | None = None
    query_prefix: str = ""
    endpoint: str = ""
    max_retries: int = 3


@dataclass
class Chunking:
    tokens: str = "regex"
    min_tokens: int = 20
    max_tokens: int = 512
    overlap_tokens: int = 50


EXTENSIONS = sorted("." + x for x in "c cpp dita ditamap docx go h hpp java js jsx md mdx pdf php pptx py rb rs rst ts tsx txt".split())
EXCLUDED = sorted("*.dylib *.map *.min.css *.min.js *.pyc *.pyo *.so .git/ .index/ .venv/ __pycache__/ build/ dist/ node_modules/ package-lock.json poetry.lock venv/ yarn.lock".split())


@dataclass
class Indexing:
    respect_gitignore: bool = True
    max_office_file_size_kb: int = 50000
    exclude_patterns: list[str] = field(default_factory=lambda: list(EXCLUDED))
    max_file_size_kb: int = 500
    file_extensions: list[str] = field(default_factory=lambda: list(EXTENSIONS))


@dataclass
class Search:
    mode: str = "hybrid"
    rerank_top_n: int = 10
    default_threshold: float = 0.3
    #: What a hybrid search without any vector hit returns: nothing, or with "keyword" the keyword hits.
    fallback: str = ""
    hybrid_alpha: float = 0.7
    default_top_k: int = 10
    rerank_model: str = "term-overlap"
    rerank_enabled: bool = False


_SECTIONS = {"embedding": Embedding, "chunking": Chunking, "indexing": Indexing, "search": Search}
PROVIDERS = ("hash", "remote", "local", "openrouter", "huggingface")
_ENV = {"QUERN_PROVIDER": "provider", "QUERN_API_KEY": "api_key", "QUERN_MODEL": "model", "QUERN_DIMENSIONS": "dimensions"}


@dataclass
class Config:
    schema_version: str = "1.0"
    embedding: Embedding = field(default_factory=Embedding)
    chunking: Chunking = field(default_factory=Chunking)
    indexing: Indexing = field(default_factory=Indexing)
    search: Search = field(default_factory=Search)
    extra: dict = field(default_factory=dict)

    def to_dict(self) -> dict:
        out = {"schema_version": self.schema_version} | {s: dataclasses.asdict(getattr(self, s)) for s in _SECTIONS}
        return out | self.extra

    @staticmethod
    def from_dict(raw: dict) -> Config:
        """Keys unknown in a section are dropped; unknown sections are kept as they are."""
        out = Config(raw.get("schema_version", "1.0"), extra={k: v for k, v in raw.items() if k != "schema_version" and k not in _SECTIONS})
        for name, kind in _SECTIONS.items():
            known = {f.name for f in dataclasses.fields(kind)}
            setattr(out, name, kind(**{k: v for k, v in raw.get(name, {}).items() if k in known}))
        return out


def validate(c: Config) -> Config:
    e, s = c.embedding, c.search
    rules = [
        ("embedding.provider", e.provider, e.provider in PROVIDERS, f"one of {', '.join(PROVIDERS)}"),
        ("embedding.device", e.device, e.device in (None, "cpu", "cuda", "mps"), "null, cpu, cuda or mps"),
        ("embedding.dimensions", e.dimensions, e.dimensions >= 1, "1 or more"),
        ("embedding.max_retries", e.max_retries, e.max_retries >= 1, "1 or more"),
        ("embedding.batch_size", e.batch_size, e.batch_size >= 1, "1 or more"),
        ("embedding.retry_delay_seconds", e.retry_delay_seconds, e.retry_delay_seconds >= 0, "0 or more"),
        ("embedding.max_embed_chars", e.max_embed_chars, e.max_embed_chars >= 1, "1 or more"),
        ("search.mode", s.mode, s.mode in ("vector", "keyword", "hybrid"), "vector, keyword or hybrid"),
        ("search.hybrid_alpha", s.hybrid_alpha, 0 <= s.hybrid_alpha <= 1, "from 0 to 1"),
        ("search.default_top_k", s.default_top_k, s.default_top_k >= 1, "1 or more"),
        ("search.rerank_top_n", s.rerank_top_n, s.rerank_top_n >= 1, "1 or more"),
    ]
    for name, value, ok, must in rules:
        if not ok:
            raise ConfigError(f"{name} is {value!r}; it must be {must}")
    return c


def config_path(project: str) -> Path:
    return Path(project) / FOLDER / FILE


def load(project: str, path: str | None = None, env: dict | None = None) -> Config:
    """A missing file gives the defaults; one that isn't JSON is an error."""
    at = Path(path) if path else config_path(project)
    config = Config()
    if at.exists():
        try:
            config = Config.from_dict(json.loads(at.read_text(encoding="utf-8")))
        except (OSError, ValueError) as exc:
            raise ConfigError(f"{at} can't be read: {exc}") from exc
    env = os.environ if env is None else env
    for name, key in _ENV.items():
        if value := env.get(name):
            if key == "dimensions":
                if not value.isdigit():
                    continue
                value = int(value)
            setattr(config.embedding, key, value)
    return validate(config)


def bootstrap(project: str) -> Path:
    """The index folder with a settings file of defaults, unless there is one."""
    at = config_path(project)
    at.parent.mkdir(parents=True, exist_ok=True)
    if not at.exists():
        at.write_text(json.dumps(Config().to_dict(), indent=2), encoding="utf-8")
    return at.parent


#: Settings that came later, and those without effect any more.
_LATER = {"embedding": ("trust_remote_code", "max_embed_chars", "device"), "search": ("hybrid_alpha", "mode", "default_threshold", "default_top_k", "rerank_top_n", "rerank_model", "rerank_enabled")}
_GONE: tuple[str, ...] = ()
_LATER_EXTENSIONS = ((".dita", ".ditamap"), (".docx", ".pdf", ".pptx"))


def analyse(raw: dict) -> list[dict]:
    """What an older settings file lacks or holds for nothing: field, action (add, remove, update), reason, old_value, new_value."""
    out = []

    def note(where, action, reason, old, new):
        out.append({"field": where, "action": action, "reason": reason, "old_value": old, "new_value": new})

    defaults = Config().to_dict()
    for section, names in _LATER.items():
        for n in names:
            if n not in raw.get(section, {}):
                note(f"{section}.{n}", "add", "a setting that came later", None, defaults[section][n])
    for n in _GONE:
        if n in raw.get("search", {}):
            note(f"search.{n}", "remove", "a setting without effect", raw["search"][n], None)
    if (v := raw.get("schema_version", "")) != "1.0":
        note("schema_version", "update" if v else "add", "the version of the settings", v or None, "1.0")
    indexing = raw.get("indexing", {})
    held = indexing.get("file_extensions") or []
    held = [held] if isinstance(held, str) else list(held)
    for wanted in _LATER_EXTENSIONS:
        if missing := [x for x in wanted if x not in held]:
            note("indexing.file_extensions", "update" if held else "add", "formats that came later", held or None, held + missing)
            held = held + missing
    if "max_office_file_size_kb" not in indexing:
        note("indexing.max_office_file_size_kb", "add", "a limit of their own for office files", None, 50000)
    return out


def migrate(raw: dict, steps: list[dict]) -> dict:
    """A copy of ``raw`` with the steps taken."""
    out = copy.deepcopy(raw)
    for step in steps:
        *above, last = step["field"].split(".")
        at = out
        for part in above:
            at = at.setdefault(part, {}) if step["action"] != "remove" else at.get(part, {})
        if step["action"] == "remove":
            at.pop(last, None)
        else:
            value = step["new_value"]
            at[last] = list(dict.fromkeys(value)) if isinstance(value, list) else value
    return out


def migrate_file(project: str, dry_run: bool = False) -> list[dict]:
    """Migrate a project's settings file in place; the steps are returned either way."""
    at = config_path(project)
    try:
        raw = json.loads(at.read_text(encoding="utf-8"))
    except (OSError, ValueError) as exc:
        raise ConfigError(f"{at} can't be read: {exc}") from exc
    steps = analyse(raw)
    if steps and not dry_run:
        at.write_text(json.dumps(migrate(raw, steps), indent=2), encoding="utf-8")
    return steps
