from .columns import avg_rank, cap, clean, cumprod, div, ffill, min_rank, r2, r4, r6, rolling, trailing

__all__ = ["avg_rank", "cap", "clean", "cumprod", "div", "ffill", "min_rank", "r2", "r4", "r6", "rolling", "trailing"]
