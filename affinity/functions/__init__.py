"""Column expressions shared by sources and operators (all JVM-side built-ins)."""

from affinity.functions.columns import epoch_millis, half_up, required, strict_cast

__all__ = ["epoch_millis", "half_up", "required", "strict_cast"]
