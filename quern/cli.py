"""``python -m quern.cli build|search|status|migrate PROJECT``: JSON on the standard output; exit 0, 1 for a bad call or setting, 2 for a failure."""

from __future__ import annotations

import argparse
import json
import sys

from quern import config as settings
from quern.errors import ConfigError
from quern.service import IndexService, failure
from quern.session import get_session


def migrate(project: str, dry_run: bool, force: bool) -> dict:
    """Changes are shown and asked about before they are made, unless forced."""
    steps = settings.migrate_file(project, dry_run=True)
    if not steps:
        return {"status": "up_to_date", "migrations": []}
    if dry_run:
        return {"status": "dry_run", "migrations": steps}
    if not force:
        for s in steps:
            print(f"{s['action']} {s['field']}: {s['reason']}", file=sys.stderr)
        print(f"make these {len(steps)} changes? [y/N] ", end="", file=sys.stderr, flush=True)
        if sys.stdin.readline().strip().lower() not in ("y", "yes"):
            return {"status": "cancelled", "migrations": steps}
    return {"status": "success", "migrations": settings.migrate_file(project)}


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="quern", description=__doc__)
    p.add_argument("--master", default=None)
    sub = p.add_subparsers(dest="action", required=True)
    for name in ("build", "search", "status", "migrate"):
        s = sub.add_parser(name)
        s.add_argument("project")
        if name == "build":
            s.add_argument("--full", action="store_true")
            s.add_argument("--batch-size", type=int, default=50)
        if name == "search":
            s.add_argument("query")
            s.add_argument("--top-k", type=int)
            s.add_argument("--threshold", type=float)
            s.add_argument("--mode", choices=("vector", "keyword", "hybrid"))
            s.add_argument("--alpha", type=float)
            s.add_argument("--filter-lang", dest="language")
            s.add_argument("--filter-path", dest="path")
            s.add_argument("--rerank", action=argparse.BooleanOptionalAction)
        if name == "migrate":
            s.add_argument("--dry-run", action="store_true", help="say what would change")
            s.add_argument("--force", action="store_true", help="don't ask before the settings are changed")
    a = p.parse_args(argv)
    try:
        if a.action == "migrate":
            out = migrate(a.project, a.dry_run, a.force)
        else:
            service = IndexService(get_session(master=a.master), a.project)
            if a.action == "build":
                out = service.build(a.full, a.batch_size)
            elif a.action == "search":
                out = service.search(a.query, top_k=a.top_k, threshold=a.threshold, mode=a.mode, alpha=a.alpha, language=a.language, path=a.path, rerank=a.rerank)
            else:
                out = service.status()
    except ConfigError as exc:
        out = failure(exc)
    print(json.dumps(out, indent=2, default=str))
    return 0 if out.get("status") != "error" else 1 if out["error_type"] == "ConfigError" else 2


if __name__ == "__main__":
    sys.exit(main())
