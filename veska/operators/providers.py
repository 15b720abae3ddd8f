"""Models of outside libraries behind one contract: contexts in, levels out.

None of these libraries or their weights comes with this package; where one is missing its
model raises ImportError on use and never makes up a forecast.
"""

from __future__ import annotations

import importlib

from veska.operators.forecast import provider, register


def _need(module: str):
    try:
        return importlib.import_module(module)
    except ImportError as e:
        raise ImportError(f"the model needs the library '{module}', which is not installed") from e


def _prophet(contexts: list[list[float]], horizon: int) -> list[list[float]]:
    import pandas as pd

    fit = _need("prophet").Prophet
    out = []
    for c in contexts:
        if len(c) < 3:
            out.append([c[-1]] * horizon if c else [])
            continue
        days = pd.date_range("2000-01-01", periods=len(c) + horizon, freq="MS")
        model = fit().fit(pd.DataFrame({"ds": days[: len(c)], "y": c}))
        out.append(model.predict(pd.DataFrame({"ds": days[len(c) :]}))["yhat"].tolist())
    return out


def adapter(name: str, module: str) -> None:
    """Register a model whose ``forecast(contexts, horizon)`` a module of the user's own
    offers, a pretrained one say: contexts are series without gaps, one list of ``horizon``
    levels each comes back.  The module is imported where the forecasts are made."""

    def predict(contexts: list[list[float]], horizon: int) -> list[list[float]]:
        got = _need(module).forecast(contexts, horizon)
        if len(got) != len(contexts) or any(len(f) != horizon for f in got):
            raise ValueError(f"{module}.forecast must give {horizon} levels for each of the contexts")
        return got

    register(name, provider(name, predict))


register("prophet", provider("prophet", _prophet))
