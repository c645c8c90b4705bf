"""Fetching and unpacking the public datasets, each step only once."""

from __future__ import annotations

import subprocess
import urllib.request
import zipfile
from collections.abc import Callable
from pathlib import Path


def fetch(url: str, target: Path, force: bool = False) -> Path:
    """Downloads to `target` unless it is there; a broken transfer leaves nothing behind."""
    if target.exists() and not force:
        return target
    target.parent.mkdir(parents=True, exist_ok=True)
    part = target.with_name(target.name + ".part")
    urllib.request.urlretrieve(url, part)
    part.replace(target)
    return target


def unpack(archive: Path, folder: Path, force: bool = False) -> Path:
    """Unzips into `folder` unless this very archive was unpacked there before: a marker per archive, as several share a folder."""
    mark = folder / f".extracted_{archive.stem}"
    if mark.exists() and not force:
        return folder
    folder.mkdir(parents=True, exist_ok=True)
    with zipfile.ZipFile(archive) as z:
        z.extractall(folder)
    mark.touch()
    return folder


def fetch_gated(repository: str, name: str, folder: Path, run: Callable = subprocess.run) -> Path:
    """A file of a gated hub repository, by its command-line client, unless it is there."""
    target = folder / name
    if not target.exists():
        run(["hf", "download", repository, name, "--repo-type", "dataset", "--local-dir", str(folder)], check=True)
    return target


def resolve_scale(dataset: str, scale: str) -> str:
    """MIND has no demo scale; its small one stands in."""
    return "small" if (dataset, scale) == ("mind", "demo") else scale


def download(config: dict, dataset: str, scale: str, root: Path, force: bool = False) -> Path:
    """All archives of a dataset's scale under `root/dataset`. `config[dataset][scale]` lists urls, or {repository, files} for a gated one; unknown names raise ValueError."""
    scale = resolve_scale(dataset, scale)
    if dataset not in config or scale not in config[dataset]:
        raise ValueError(f"unknown dataset or scale: {dataset}/{scale}")
    folder = root / dataset
    spec = config[dataset][scale]
    names = [fetch_gated(spec["repository"], f, folder) for f in spec["files"]] if isinstance(spec, dict) else [fetch(u, folder / u.rsplit("/", 1)[-1], force) for u in spec]
    for a in names:
        unpack(a, folder / a.stem, force)
    return folder
