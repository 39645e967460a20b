"""Configuration: defaults, replaced key by key by a YAML file's."""

from __future__ import annotations

from mailweave import words

DEFAULTS = {
    "signature_markers": words.SIGNATURE_MARKERS, "disclaimer_phrases": words.DISCLAIMER_PHRASES, "materials": words.MATERIALS, "engineering_keywords": words.ENGINEERING_KEYWORDS,
    "unresolved_markers": words.UNRESOLVED_MARKERS, "role_keywords": words.ROLE_KEYWORDS,
}


def load_config(path: str | None = None) -> dict:
    """The defaults, each key that the file gives replaced whole; a file that is missing or unreadable gives the defaults."""
    out = dict(DEFAULTS)
    if path:
        try:
            import yaml

            with open(path, encoding="utf-8") as f:
                given = yaml.safe_load(f)
        except ImportError:
            given = _lists(path)
        except Exception as e:  # noqa: BLE001
            print(f"configuration {path} can't be read ({e}); defaults are used")
            given = None
        out.update(given if isinstance(given, dict) else {})
    return out


def _lists(path: str) -> dict:
    """Keys with lists of plain or quoted texts: as much YAML as the configuration needs where no parser is installed."""
    out: dict[str, object] = {}
    key = None
    try:
        with open(path, encoding="utf-8") as f:
            for line in f:
                bare = line.split(" #")[0].rstrip()
                if not bare or bare.lstrip().startswith("#"):
                    continue
                if bare.lstrip().startswith("- ") and key:
                    if not isinstance(out.get(key), list):
                        out[key] = []
                    out[key].append(bare.lstrip()[2:].strip().strip("\"'"))
                elif bare[0] not in " \t" and ":" in bare:
                    key, _, value = bare.partition(":")
                    out[key] = value.strip().strip("\"'") or None
    except OSError as e:
        print(f"configuration {path} can't be read ({e}); defaults are used")
    return {k: v for k, v in out.items() if v is not None}
