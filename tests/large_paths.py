"""Lowers the size limits, so that small tables take the paths meant for large ones."""

import sys
import types

LIMITS = {"hot_rows": 40}


def force() -> int:
    """Replaces the limits' defaults in all loaded library functions; returns how many."""
    changed = 0
    for name, module in list(sys.modules.items()):
        if not name.startswith("careflow"):
            continue
        for fn in vars(module).values():
            if not isinstance(fn, types.FunctionType) or not fn.__defaults__:
                continue
            names = fn.__code__.co_varnames[: fn.__code__.co_argcount][-len(fn.__defaults__) :]
            new = tuple(LIMITS.get(n, d) if isinstance(d, int) else d for n, d in zip(names, fn.__defaults__))
            if new != fn.__defaults__:
                fn.__defaults__, changed = new, changed + 1
    from careflow.operators import admission, joins

    joins.BROADCAST_BYTES = 0
    admission.SLOW_SHARE = 0.0
    return changed
