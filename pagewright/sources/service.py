"""What a PDF service would be told and needs: form fields, the device, and where its models come from.

The services themselves aren't part of this library; these are their rules, as functions without side effects.
"""

from __future__ import annotations

import os
from typing import Any

POLICIES = ("require_existing", "download_if_missing")


def form_fields(config: dict[str, Any]) -> dict[str, str]:
    """The text fields of a request: Markdown and no archive is asked for; plain text extraction where OCR is switched off; the device and the
    folders if they are set; of the extra options those with a value."""
    fields = {"return_md": "true", "response_format_zip": "false"}
    if config.get("enable_ocr") is False:
        fields["method"] = "txt"
    fields |= {key: str(config[key]) for key in ("device", "model_dir", "download_dir") if config.get(key)}
    return fields | {str(k): str(v) for k, v in (config.get("extra_options") or {}).items() if v is not None}


def device(asked: str, gpu: bool) -> str:
    """The device for what is asked: auto takes a GPU where there is one. Asking for one that isn't there is an error."""
    if asked == "auto":
        return "cuda" if gpu else "cpu"
    if asked == "cuda" and not gpu:
        raise RuntimeError("The device cuda is asked for but not available.")
    return asked


def check_models(config: dict[str, Any], home: str | None = None) -> None:
    """Whether the policy is known and, if models must exist already, the model folder holds something or the service's home (the download
    folder, else the user's) has a cache or a configuration of it."""
    policy = config.get("model_policy", "download_if_missing")
    if policy not in POLICIES:
        raise ValueError(f"Unsupported model policy: {policy}. Known ones: {', '.join(POLICIES)}.")
    if policy != "require_existing":
        return
    folder = os.path.expanduser(config.get("model_dir") or "")
    if folder:
        if not os.path.isdir(folder) or not os.listdir(folder):
            raise RuntimeError(f"Models must exist, but their folder is missing or empty: {folder}")
        return
    root = os.path.expanduser(config.get("download_dir") or home or "~")
    if not any(os.path.exists(os.path.join(root, n)) for n in ("mineru.json", ".mineru")):
        raise RuntimeError(f"Models must exist, but there is neither a model folder nor a cache below {root}")
