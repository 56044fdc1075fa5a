"""Settings: defaults, then a JSON file, then the environment, then what is given at a call."""

from __future__ import annotations

import copy
import json
import os
import warnings
from pathlib import Path
from typing import Any

PREFIX = "PAGEWRIGHT_"
FILE = Path.home() / ".pagewright" / "config.json"
_SERVICE: dict[str, Any] = dict.fromkeys(("api_url", "download_dir", "model_dir", "model_source"))
_SERVICE |= dict(api_port=8000, api_command="mineru-api", auto_install_runtime=False, api_start_timeout=30.0, api_host="127.0.0.1")
_SERVICE |= dict(device="auto", enable_ocr=True, extra_options={}, model_policy="download_if_missing", request_timeout=300.0, runtime_package="mineru[all]")
_VISION = dict(api_key=None, model="gpt-4o", provider="openai")
DEFAULTS: dict[str, Any] = dict(engines=dict(mineru=_SERVICE, vision_llm=_VISION), default_pdf_engine="simple")
#: Environment names to dotted keys. The service's time limit for a request and its extra options have none.
ENVIRONMENT = {PREFIX + "DEFAULT_PDF_ENGINE": "default_pdf_engine"} | {
    f"{PREFIX}MINERU_{k.upper()}": f"engines.mineru.{k}" for k in _SERVICE if k not in ("request_timeout", "extra_options")
}
_YES, _NO = set("on yes 1 true".split()), set("off no 0 false".split())


def merged(base: dict, update: dict) -> dict:
    """base overlaid by update, dictionaries key by key."""
    out = dict(base)
    for k, v in update.items():
        out[k] = merged(out[k], v) if isinstance(out.get(k), dict) and isinstance(v, dict) else v
    return out


def from_text(value: str, current: Any = None) -> Any:
    """A setting given as text: words for yes and no where it was a bool, words for nothing where it was null, else
    JSON if it is any, else the text."""
    text = value.strip()
    low = text.lower()
    if isinstance(current, bool) and low in _YES | _NO:
        return low in _YES
    if current is None and low in ("null", "none", ""):
        return None
    try:
        return json.loads(text)
    except ValueError:
        return text


class Config:
    def __init__(self, file: Path | None = None, environment: dict[str, str] | None = None) -> None:
        self.values = copy.deepcopy(DEFAULTS)
        path, env = file or FILE, os.environ if environment is None else environment
        if path.exists():
            try:
                self.values = merged(self.values, json.loads(path.read_text(encoding="utf-8")))
            except (ValueError, OSError, AttributeError) as e:
                warnings.warn(f"the config file could not be read: {e}", stacklevel=2)
        for name, key in ENVIRONMENT.items():
            if name in env:
                self.set(key, from_text(env[name], self.get(key)))

    def get(self, key: str, otherwise: Any = None) -> Any:
        at: Any = self.values
        for part in key.split("."):
            if not isinstance(at, dict) or part not in at:
                return otherwise
            at = at[part]
        return at

    def set(self, key: str, value: Any) -> None:
        *outer, last = key.split(".")
        at = self.values
        for part in outer:
            if not isinstance(at.get(part), dict):
                at[part] = {}
            at = at[part]
        at[last] = value

    def engine(self, name: str | None = None, **given: Any) -> dict[str, Any]:
        """An engine's settings with what is given at the call; extra_options are joined key by key. Nothing given (None
        or False) leaves the setting as it is."""
        name = name or self.get("default_pdf_engine")
        given = {k: v for k, v in given.items() if v is not None and v is not False}
        base = self.get(f"engines.{name}", {})
        out = {**base, **given}
        if isinstance(base.get("extra_options"), dict) and isinstance(given.get("extra_options"), dict):
            out["extra_options"] = {**base["extra_options"], **given["extra_options"]}
        return out
