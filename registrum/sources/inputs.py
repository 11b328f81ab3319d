"""Where a build's inputs are: archives and their dates, the publish to take, downloads, and code lists."""

import re
import shutil
import time
import urllib.request
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_DATED = re.compile(r"(\d{4})(\d{2})(\d{2})-")


def first_member(archive: str) -> str:
    with zipfile.ZipFile(archive) as z:
        return z.namelist()[0]


def extract(archive: str, folder: str) -> str:
    """The archive's first member, written once into a shared folder that Spark can split; its path."""
    with zipfile.ZipFile(archive) as z:
        info = z.infolist()[0]
        target = Path(folder) / Path(info.filename).name
        if not target.exists() or target.stat().st_size != info.file_size:
            part = target.with_suffix(target.suffix + ".part")
            with z.open(info) as source, part.open("wb") as out:
                shutil.copyfileobj(source, out, 1 << 20)
            part.replace(target)
    return str(target)


def local_inputs(folder: str, needed: list[str], optional: list[str] = (), dated: str | None = None) -> dict[str, str | None]:
    """Paths of the files, in the folder or its subfolder "signals", and as_of: the date in the name of the dated archive's member.
    Fails with the folder's list if one is missing."""
    top = Path(folder)
    look = lambda name: next((str(p) for p in (top / name, top / "signals" / name) if p.is_file()), None)
    found = {name: look(name) for name in [*needed, *optional]}
    for name in needed:
        if found[name] is None:
            raise FileNotFoundError(f"{name} is not in {folder}; it has {', '.join(sorted(p.name for p in top.iterdir())) if top.is_dir() else 'no such folder'}")
    if dated:
        m = _DATED.match(first_member(found[dated]))
        if not m:
            raise ValueError(f"no date in the member of {found[dated]}")
        found["as_of"] = "-".join(m.groups())
    return found


def resolve_publish(publishes: DataFrame, date: str) -> DataFrame:
    """The row of publishes (publish_date "YYYY-MM-DD HH:MM:SS", ...) to take: the newest for "latest"; else that day's of 08:00, or its
    newest."""
    if date == "latest":
        return publishes.orderBy(F.col("publish_date").desc()).limit(1)
    if not re.fullmatch(r"\d{4}-\d{2}-\d{2}", date):
        raise ValueError(f"publish date {date} is not YYYY-MM-DD or latest")
    day = publishes.where(F.startswith("publish_date", F.lit(date)))
    return day.orderBy((F.col("publish_date") == f"{date} 08:00:00").desc(), F.col("publish_date").desc()).limit(1)


def download(url: str, path: str, size: int | None = None, attempts: int = 4, idle: float = 60.0, wait: float = 1.0) -> str:
    """Fetches a file beside its place and moves it there when it is whole (size, sound archive); tries again with longer waits."""
    target = Path(path)
    part = target.with_suffix(target.suffix + ".part")
    for attempt in range(attempts):
        try:
            with urllib.request.urlopen(url, timeout=idle) as source, part.open("wb") as out:
                shutil.copyfileobj(source, out, 1 << 20)
            if size is not None and part.stat().st_size != size:
                raise OSError(f"{url}: {part.stat().st_size} bytes of {size}")
            if target.suffix == ".zip":
                with zipfile.ZipFile(part) as z:
                    if (bad := z.testzip()) is not None:
                        raise OSError(f"{url}: bad member {bad}")
            part.replace(target)
            return path
        except (OSError, zipfile.BadZipFile):
            part.unlink(missing_ok=True)
            if attempt == attempts - 1:
                raise
            time.sleep(wait * 2**attempt)
    raise ValueError("no attempts")


def code_list(rows: DataFrame, code: str, columns: list[str], row: str) -> DataFrame:
    """(code, name): the first of a code's rows with a name, the first of the columns that has one; blank codes go."""
    trim = lambda c: F.regexp_replace(F.coalesce(F.col(c), F.lit("")), r"^\s+|\s+$", "")
    name = F.coalesce(*(F.nullif(trim(c), F.lit("")) for c in columns))
    named = rows.select(trim(code).alias("code"), name.alias("name"), F.col(row).alias("row_")).where((F.col("code") != "") & F.col("name").isNotNull())
    return named.groupBy("code").agg(F.min_by("name", "row_").alias("name"))


def codes_document(forms: DataFrame, registers: DataFrame | None = None) -> str:
    """Compact JSON of code lists (code, name) with keys in order. Code lists have thousands of rows; this is a file of the index."""
    import json

    listed = lambda df: {r["code"]: r["name"] for r in df.select("code", "name").collect()}
    out = {"elf": listed(forms)} | ({} if registers is None else {"ra": listed(registers)})
    return json.dumps(out, ensure_ascii=False, sort_keys=True, separators=(",", ":"))
