"""Settings of an installation, from the session's configuration or lines of a file."""

from __future__ import annotations

import dataclasses
import datetime as dt
import json
from dataclasses import dataclass, field
from zoneinfo import ZoneInfo

from pyspark.sql import SparkSession

PREFIX = "spark.eocatalog."


@dataclass(frozen=True)
class Settings:
    grouping_timezone: str = "Australia/Darwin"
    grouping_srid: int = 3577
    page_size: int = 20
    max_page_size: int = 1000
    api_limit: int = 500
    api_hard_limit: int = 4000
    search_hard_limit: int = 150
    month_page: int = 500
    change_overlap: dt.timedelta = dt.timedelta(minutes=15)
    default_licence: str | None = None
    s3_region: str = "ap-southeast-2"
    #: Buckets whose addresses are shown as those of a site that serves them.
    data_locations: dict[str, str] = field(default_factory=dict)

    def __post_init__(self):
        ZoneInfo(self.grouping_timezone)  # an unknown zone is an error here and not in a task
        if not 0 < self.page_size <= self.max_page_size:
            raise ValueError("page_size is from 1 to max_page_size")


def _read(name: str, text: str):
    kind = {f.name: f for f in dataclasses.fields(Settings)}.get(name)
    if kind is None:
        raise ValueError(f"no setting {name!r}")
    default = kind.default if kind.default is not dataclasses.MISSING else {}
    if isinstance(default, dt.timedelta):
        return dt.timedelta(seconds=float(text))
    if isinstance(default, dict):
        found = json.loads(text)
        if not isinstance(found, dict):
            raise ValueError(f"{name} is a JSON object")
        return found
    return int(text) if isinstance(default, int) else text


def of_session(spark: SparkSession) -> Settings:
    """What the session sets below spark.eocatalog, and defaults. ValueError for a name that there isn't."""
    given = {k[len(PREFIX) :]: v for k, v in spark.conf.getAll.items() if k.startswith(PREFIX)}
    return Settings(**{k: _read(k, v) for k, v in given.items()})


def of_lines(text: str, prefix: str = "EOCATALOG_") -> Settings:
    """Settings of ``EOCATALOG_NAME=value`` lines, quoted or not; comments and other names are passed over."""
    given = {}
    for line in text.splitlines():
        name, sep, value = line.partition("=")
        name = name.strip().removeprefix("export ").strip()
        if sep and name.startswith(prefix):
            given[name[len(prefix) :].lower()] = value.strip().strip("\"'")
    return Settings(**{k: _read(k, v) for k, v in given.items()})
