"""Parsers of model output: JSON in noisy text, tagged blocks, a line language with heredocs, pytest summaries."""

from __future__ import annotations

import json
import re

ACTIONS = ("inspect_task", "list_files", "read_file", "search_text", "run_tests", "inspect_error", "propose_patch", "apply_patch", "rollback_patch", "write_memory", "finish")
_FENCE = re.compile(r"```(?:json)?\s*\n?(.*?)```", re.S)


def repair_json(raw: str) -> str:
    """Without fences, without commas before a closing bracket, and with the brackets closed that are open at the end.

    One pass with a stack of open brackets and the state of strings: what stands in a string is never touched, and a text that ends in a string
    or closes what is not open is left as it is, for the parser to refuse.
    """
    m = _FENCE.search(raw)
    text = (m[1] if m else raw).strip()
    out, stack, quoted, escaped = [], [], False, False
    comma = None  # where in `out` a comma stands behind which only white space has come
    for c in text:
        if quoted:
            quoted, escaped = escaped or c != '"', c == "\\" and not escaped
        elif c == '"':
            quoted = True
        elif c in "{[":
            stack.append("}" if c == "{" else "]")
        elif c in "}]":
            if not stack or stack.pop() != c:
                return text
            if comma is not None:
                del out[comma:]
        if not c.isspace():
            comma = len(out) if c == "," and not quoted else None
        out.append(c)
    return text if quoted else "".join(out + stack[::-1])


def extract_json(raw: str | None) -> dict | None:
    """The first JSON object of a text: fenced, bare or repaired; None if there is none."""
    raw = raw or ""
    m = _FENCE.search(raw)
    for text in ([m[1]] if m else []) + [raw]:
        at = text.find("{")
        while at >= 0:
            try:
                out, _ = json.JSONDecoder().raw_decode(text, at)
                if isinstance(out, dict):
                    return out
            except ValueError:
                pass
            at = text.find("{", at + 1)
    try:
        fixed = repair_json(raw)
        out = json.loads(fixed[fixed.index("{") :])
        return out if isinstance(out, dict) else None
    except ValueError:
        return None


def parse_tags(raw: str | None) -> dict | None:
    """{action, arguments} of `<action name="...">key: value ... <content>...</content></action>`."""
    m = re.search(r'<action(?:\s+name="?(\w+)"?)?>(.*?)</action>', raw or "", re.S)
    if not m:
        return None
    body, held = m[2], []
    body = re.sub(r"<content>(.*?)</content>", lambda k: held.append(k[1]) or f"\0{len(held) - 1}\0", body, flags=re.S)
    args = {k.strip(): v.strip() for k, v in re.findall(r"^\s*([A-Za-z_]\w*)\s*[:=]\s*(.*)$", body, re.M)}
    args = {k: re.sub(r"\0(\d+)\0", lambda x: held[int(x[1])], v) for k, v in args.items()}
    return {"action": m[1] or args.pop("type", None), "arguments": args}


def parse_dsl(raw: str | None) -> dict | None:
    """{action, arguments} of `ACTION name`, then `key value` lines; `key <<END` takes the lines up to END."""
    lines, out, i = (raw or "").split("\n"), None, 0
    while i < len(lines):
        line = lines[i].strip()
        i += 1
        if out is None:
            if m := re.fullmatch(r"ACTION\s+(\w+)", line):
                out = {"action": m[1], "arguments": {}}
        elif m := re.fullmatch(r"(\w+)\s+<<(\w+)", line):
            end = next((k for k in range(i, len(lines)) if lines[k].strip() == m[2]), None)
            if end is None:
                return None
            out["arguments"][m[1]] = "\n".join(lines[i:end])
            i = end + 1
        elif m := re.fullmatch(r"(\w+)\s+(.+)", line):
            out["arguments"][m[1]] = m[2]
    return out


def diagnose(parsed: dict | None) -> dict:
    """Independent validity of a parsed action and the first failing class."""
    name = (parsed or {}).get("action")
    args = (parsed or {}).get("arguments")
    checks = {"format_ok": parsed is not None, "type_ok": name in ACTIONS, "safety_ok": path_error(args.get("path")) is None if isinstance(args, dict) and "path" in args else True, "arguments_ok": isinstance(args, dict)}
    names = {"format_ok": "FORMAT_PARSE_FAIL", "type_ok": "ACTION_TYPE_FAIL", "safety_ok": "SAFETY_FAIL", "arguments_ok": "SCHEMA_VALIDATION_FAIL"}
    return {**checks, "failure_class": next((names[k] for k, ok in checks.items() if not ok), None)}


def path_error(path: str | None) -> str | None:
    """Why a path may not be touched, or None."""
    p = path or ""
    rules = [(not p, "empty"), (bool(re.match(r"[a-z]+://", p)), "url"), (bool(re.match(r"/|[A-Za-z]:|\\\\", p)), "absolute"), (".." in re.split(r"[/\\]", p), "parent"), (re.split(r"[/\\]", p)[-1] in (".env", ".netrc", "id_rsa", "credentials"), "secret name"), (p.endswith((".pem", ".key")), "key file")]
    return next((why for bad, why in rules if bad), None)


def pytest_counts(output: str | None) -> dict[str, int]:
    """Passed, failed and error counts of the last summary line."""
    for line in reversed((output or "").splitlines()):
        if found := re.findall(r"(\d+) (passed|failed|errors?)", line):
            n = {k.rstrip("s") if k.startswith("error") else k: int(v) for v, k in found}
            return {k: n.get(k, 0) for k in ("passed", "failed", "error")}
    return {"passed": 0, "failed": 0, "error": 0}


def compress_feedback(output: str | None, limit: int = 3000) -> str:
    """The lines of a test log that say what failed, cut at `limit` characters with a marker."""
    lines = [x for x in (output or "").splitlines() if re.search(r"Error|assert|FAILED|^E\s|passed|failed", x)]
    text = "\n".join(lines)
    return text if len(text) <= limit else text[:limit] + "\n...[truncated]"
