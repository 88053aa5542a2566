"""Remote lookups: distinct keys are dealt to a few partitions, each with its own pace and retries."""

from __future__ import annotations

import json
import os
import time
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Callable, Iterator
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame

#: Service -> (URL of a key, seconds between calls).
SERVICES = {
    "pubchem_cid": ("https://pubchem.ncbi.nlm.nih.gov/rest/pug/compound/cid/{key}/JSON", 0.2),
    "pubchem_name": ("https://pubchem.ncbi.nlm.nih.gov/rest/pug/compound/name/{key}/JSON", 0.2),
    "pubchem_synonyms": ("https://pubchem.ncbi.nlm.nih.gov/rest/pug/compound/cid/{key}/synonyms/JSON", 0.2),
    "pubchem_view": ("https://pubchem.ncbi.nlm.nih.gov/rest/pug_view/data/compound/{key}/JSON?heading=Experimental+Properties", 0.2),
    "nci": ("https://cactus.nci.nih.gov/chemical/structure/{key}/{option}", 0.1),
    "opsin": ("https://opsin.ch.cam.ac.uk/opsin/{key}.json", 0.5),
    "chebi": ("https://www.ebi.ac.uk/chebi/backend/api/public/compound/{key}/", 0.0),
    "cas": ("https://commonchemistry.cas.org/api/detail?cas_rn={key}", 0.0),
    "classyfire": ("http://classyfire.wishartlab.com/queries/{key}.json", 0.0),
}

Fetch = Callable[[str], tuple[int, str | None]]


def http_get(url: str, timeout: float = 30, headers: dict[str, str] | None = None) -> tuple[int, str | None]:
    """Status and body; status 0 for a call that got no answer."""
    try:
        with urllib.request.urlopen(urllib.request.Request(url, headers=headers or {}), timeout=timeout) as reply:
            return reply.status, reply.read().decode("utf-8", "replace")
    except urllib.error.HTTPError as e:
        return e.code, None
    except OSError:
        return 0, None


def build_url(service: str, key: str, option: str = "") -> str:
    return SERVICES[service][0].format(key=urllib.parse.quote(str(key), safe=""), option=option)


def fetch(keys: DataFrame, key: str, service: str, option: str = "", get: Fetch = http_get, partitions: int = 4, retries: int = 3, pause: float | None = None) -> DataFrame:
    """key, url, status, body for the distinct present keys; a failed call is a row, not an error. Not-found answers aren't tried again."""
    wait = SERVICES[service][1] if pause is None else pause

    return run_calls(keys, key, lambda k: (build_url(service, k, option), None), lambda url, body: get(url), wait, partitions, retries)


Send = Callable[[str, str | None], tuple[int, str | None]]


def http_send(url: str, body: str | None = None, timeout: float = 30, headers: dict[str, str] | None = None) -> tuple[int, str | None]:
    """As http_get; with a body the call is a POST."""
    if body is None:
        return http_get(url, timeout, headers)
    try:
        request = urllib.request.Request(url, data=body.encode(), headers=headers or {}, method="POST")
        with urllib.request.urlopen(request, timeout=timeout) as reply:
            return reply.status, reply.read().decode("utf-8", "replace")
    except urllib.error.HTTPError as e:
        return e.code, None
    except OSError:
        return 0, None


def run_calls(keys: DataFrame, key: str, request: Callable[[str], tuple[str, str | None]], send: Send, wait: float, partitions: int, retries: int) -> DataFrame:
    """key, url, status, body for the distinct present keys, each partition at its own pace; refused calls (4xx) aren't tried again."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last = 0.0
        for batch in batches:
            rows = []
            for value in batch["key"]:
                (url, data), status, body = request(value), 0, None
                for attempt in range(retries + 1):
                    time.sleep(max(0.0, last + wait * 2**attempt - time.time()))
                    last = time.time()
                    status, body = send(url, data)
                    if status == 200 or 400 <= status < 500:
                        break
                rows.append((value, url, status, body))
            yield pd.DataFrame(rows, columns=["key", "url", "status", "body"])

    distinct = keys.selectExpr(f"cast(`{key}` as string) as key").where("key is not null").distinct().repartition(partitions, "key")
    return distinct.mapInPandas(run, "key string, url string, status int, body string")


class Settings:
    """API keys in a JSON file of the user's; an environment variable KEYWEAVE_<SERVICE>_KEY wins."""

    def __init__(self, path: str | None = None) -> None:
        self.path = Path(path or os.path.join(os.path.expanduser("~"), ".config", "keyweave", "settings.json"))

    def load(self) -> dict:
        return json.loads(self.path.read_text()) if self.path.exists() else {}

    def save(self, values: dict) -> None:
        self.path.parent.mkdir(parents=True, exist_ok=True)
        self.path.write_text(json.dumps(values, indent=2))
        self.path.chmod(0o600)

    def key(self, service: str) -> str | None:
        return os.environ.get(f"KEYWEAVE_{service.upper()}_KEY") or self.load().get("keys", {}).get(service)

    def set_key(self, service: str, key: str) -> None:
        values = self.load()
        self.save(values | {"keys": values.get("keys", {}) | {service: key}})

    def remove_key(self, service: str) -> bool:
        values = self.load()
        found = values.get("keys", {}).pop(service, None) is not None
        if found:
            self.save(values)
        return found

    def services(self) -> list[str]:
        return sorted(self.load().get("keys", {}))
