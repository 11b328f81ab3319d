"""Publishing a build: two builds side by side, the manifest last, and reading back what was published."""

import hashlib
import json
import os
import shutil
from pathlib import Path

FILE_LIMIT = 20_000


def sample_paths(build: str, files: int) -> list[str]:
    """The paths that a verification reads: the first, last and quartile files, the code names and the report."""
    picks = sorted({n for n in (0, files // 4, files // 2, 3 * files // 4, files - 1) if 0 <= n < files})
    return [*(f"{build}/{n}.txt" for n in picks), f"{build}/codes.json", f"{build}/report.json"]


def _digest(path: Path) -> str:
    with path.open("rb") as f:
        return hashlib.file_digest(f, "sha256").hexdigest()


def assemble(build_dir: str, out: str, live_dir: str | None = None, most_files: int = FILE_LIMIT) -> dict:
    """Puts the build of build_dir (index.json, measured.json and a folder of files) into out beside the live build, which readers of
    the old manifest still need, then replaces the manifest in one step. Fails before that if checks did not pass, files are missing,
    copies differ or there would be more than most_files."""
    src, dst = Path(build_dir), Path(out)
    measured, manifest = (json.loads((src / n).read_text("utf8")) for n in ("measured.json", "index.json"))
    if not measured.get("passed"):
        raise ValueError("the checks did not pass for this build")
    name = manifest["build"]
    if measured["report"]["build"] != name:
        raise ValueError(f"measured.json is for {measured['report']['build']}, index.json names {name}")
    wanted = [f"{n}.txt" for n in range(len(manifest["bounds"]))] + ["codes.json"]
    missing = [n for n in wanted if not (src / name / n).is_file()]
    if missing:
        raise FileNotFoundError(f"{len(missing)} files of {name} are missing, such as {missing[0]}")
    live = json.loads((Path(live_dir) / "index.json").read_text("utf8")) if live_dir and (Path(live_dir) / "index.json").is_file() else None
    kept = sorted(p for p in (Path(live_dir) / live["build"]).iterdir()) if live and live["build"] != name else []
    if len(wanted) + 2 + len(kept) > most_files:
        raise ValueError(f"{len(wanted) + 2 + len(kept)} files are more than {most_files}")
    (dst / name).mkdir(parents=True, exist_ok=True)
    for n in wanted:
        shutil.copyfile(src / name / n, dst / name / n)
        if _digest(src / name / n) != _digest(dst / name / n):
            raise OSError(f"{n} differs after the copy")
    (dst / name / "report.json").write_text(json.dumps(measured["report"], indent=2) + "\n", "utf8")
    for p in kept:
        (dst / live["build"]).mkdir(exist_ok=True)
        if not (dst / live["build"] / p.name).exists():
            shutil.copyfile(p, dst / live["build"] / p.name)
    part = dst / "index.json.part"
    shutil.copyfile(src / "index.json", part)
    os.replace(part, dst / "index.json")
    return {"build": name, "previous": live["build"] if kept else None, "files": len(wanted) + 2 + len(kept)}


def verify(out: str, build_dir: str) -> list[str]:
    """What is wrong with the published build: the manifest or a sampled file is missing or differs. Empty if nothing is."""
    src, dst = Path(build_dir), Path(out)
    manifest = json.loads((src / "index.json").read_text("utf8"))
    wrong = [] if (dst / "index.json").is_file() and _digest(dst / "index.json") == _digest(src / "index.json") else ["index.json differs"]
    for path in sample_paths(manifest["build"], len(manifest["bounds"])):
        if not (dst / path).is_file():
            wrong.append(f"{path} is missing")
        elif (src / path).is_file() and _digest(src / path) != _digest(dst / path):
            wrong.append(f"{path} differs")
    return wrong
