from .numeric import average_rank, clip, corr, div, finite, first_rank, group_count, min_max, true_if, true_unless, z_population, z_population_strict, z_sample

__all__ = ["average_rank", "clip", "corr", "div", "finite", "first_rank", "group_count", "min_max", "true_if", "true_unless", "z_population", "z_population_strict", "z_sample"]
