"""Dimension tables: tags, categories, prerequisites. Taxonomies and term dictionaries of other sizes are
parameters (DataFrames with the same columns)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# The tags of each category.
CATEGORIES: dict[str, list[str]] = {
    "数据结构": [
        "array", "linked_list", "stack", "queue", "deque",
        "hash_map", "hash_set", "binary_tree", "binary_tree_traverse",
        "bst", "heap", "union_find", "segment_tree",
        "fenwick_tree", "sparse_table", "sqrt_decomposition", "treap",
        "splay_tree", "bitset", "persistent_segment_tree",
        "monotonic_stack", "monotonic_queue", "priority_queue",
    ],
    "字符串": [
        "kmp", "ac_automaton", "suffix_array", "sam", "lcp",
        "z_algorithm", "manacher", "rolling_hash", "trie",
        "palindrome_tree", "minimum_expression",
    ],
    "图论": [
        "dfs", "bfs", "shortest_path", "dijkstra", "bellman_ford",
        "floyd_warshall", "spfa", "topological_sort", "scc", "tarjan",
        "kosaraju", "bcc", "cut_vertex", "bridge", "mst", "kruskal",
        "prim", "tree_diameter", "tree_centroid", "lca",
        "heavy_light_decomposition", "bipartite_matching",
        "max_flow", "dinic", "min_cost_max_flow", "isap",
        "euler_path", "hamilton_path",
    ],
    "动态规划": [
        "linear_dp", "knapsack", "interval_dp", "tree_dp",
        "bitmask_dp", "state_compression_dp", "digit_dp",
        "probability_dp", "game_dp", "lcs", "lis",
        "matrix_chain", "edit_distance",
    ],
    "数学": [
        "number_theory", "combinatorics", "probability", "linear_algebra",
        "matrix_exponentiation", "fft", "ntt", "fwt", "generating_function",
        "game_theory", "inclusion_exclusion", "burnside", "polya",
        "sterlings", "catalan_number", "mobius_inversion",
        "prime", "gcd", "exgcd", "modular_arithmetic", "crt",
        "miller_rabin", "pollard_rho", "euler_function",
        "gaussian_elimination", "simplex", "integer_programming",
        "complex_number",
    ],
    "搜索": [
        "binary_search", "ternary_search", "meet_in_the_middle",
        "bidirectional_bfs", "a_star", "ida_star",
        "backtracking", "branch_and_bound", "heuristic_search",
    ],
    "排序": [
        "quick_sort", "merge_sort", "counting_sort",
        "bucket_sort", "radix_sort", "heap_sort",
    ],
    "技巧": [
        "two_pointers", "sliding_window", "prefix_sum", "difference_array",
        "discretization", "coordinate_compression", "greedy",
        "divide_and_conquer", "recursion", "bruteforce",
        "constructive", "random", "interactive", "simulation",
        "bitwise_operation",
    ],
    "计算几何": [
        "computational_geometry", "convex_hull", "rotating_calipers",
        "half_plane_intersection", "scanline",
    ],
}

# What a tag builds on.
PREREQUISITES: dict[str, list[str]] = {
    "backtracking":      ["binary_tree_traverse"],
    "bfs":               ["binary_tree_traverse"],
    "tree_dp":           ["binary_tree_traverse", "linear_dp"],
    "bitmask_dp":        ["backtracking"],
    "shortest_path":     ["union_find", "bfs"],
    "mst":               ["union_find"],
    "kmp":               ["two_pointers"],
    "ac_automaton":      ["kmp", "trie"],
    "segment_tree":      ["binary_tree"],
    "fenwick_tree":      ["prefix_sum"],
    "sparse_table":      ["prefix_sum"],
    "sqrt_decomposition": ["prefix_sum"],
    "persistent_segment_tree": ["segment_tree"],
    "treap":             ["bst"],
    "splay_tree":        ["bst"],
    "monotonic_stack":   ["stack"],
    "monotonic_queue":   ["queue"],
    "topological_sort":  ["dfs"],
    "scc":               ["dfs"],
    "tarjan":            ["dfs"],
    "kosaraju":          ["dfs"],
    "bcc":               ["dfs", "scc"],
    "cut_vertex":        ["tarjan"],
    "bridge":            ["tarjan"],
    "dijkstra":          ["bfs", "heap"],
    "bellman_ford":      ["shortest_path"],
    "spfa":              ["bellman_ford"],
    "floyd_warshall":    ["shortest_path"],
    "max_flow":          ["bfs"],
    "dinic":             ["max_flow", "bfs"],
    "min_cost_max_flow": ["max_flow"],
    "isap":              ["max_flow"],
    "bipartite_matching": ["max_flow", "dfs"],
    "euler_path":        ["dfs"],
    "hamilton_path":     ["backtracking"],
    "lca":               ["binary_tree", "sparse_table"],
    "heavy_light_decomposition": ["segment_tree", "binary_tree_traverse"],
    "tree_diameter":     ["bfs", "binary_tree_traverse"],
    "tree_centroid":     ["binary_tree_traverse"],
    "kruskal":           ["union_find"],
    "prim":              ["heap"],
    "a_star":            ["bfs", "dijkstra"],
    "ida_star":          ["backtracking"],
    "bidirectional_bfs": ["bfs"],
    "suffix_array":      ["kmp"],
    "sam":               ["suffix_array", "trie"],
    "palindrome_tree":   ["trie"],
    "z_algorithm":       ["rolling_hash"],
    "manacher":          ["two_pointers"],
    "rolling_hash":      ["prefix_sum"],
    "minimum_expression": ["two_pointers"],
    "knapsack":          ["linear_dp"],
    "interval_dp":       ["linear_dp"],
    "digit_dp":          ["linear_dp"],
    "state_compression_dp": ["bitmask_dp"],
    "probability_dp":    ["linear_dp"],
    "game_dp":           ["linear_dp"],
    "lis":               ["linear_dp", "binary_search"],
    "lcs":               ["linear_dp"],
    "edit_distance":     ["linear_dp"],
    "matrix_chain":      ["interval_dp"],
    "matrix_exponentiation": ["linear_algebra"],
    "fft":               ["complex_number"],
    "ntt":               ["fft", "modular_arithmetic"],
    "fwt":               ["fft"],
    "generating_function": ["combinatorics", "fft"],
    "inclusion_exclusion": ["combinatorics"],
    "polya":             ["burnside"],
    "mobius_inversion":  ["number_theory"],
    "miller_rabin":      ["modular_arithmetic"],
    "crt":               ["modular_arithmetic"],
    "pollard_rho":       ["miller_rabin"],
    "simplex":           ["linear_algebra"],
    "gaussian_elimination": ["linear_algebra"],
    "catalan_number":    ["combinatorics"],
    "sterlings":         ["combinatorics"],
    "meet_in_the_middle": ["binary_search", "bruteforce"],
    "branch_and_bound":  ["backtracking"],
    "half_plane_intersection": ["convex_hull"],
    "rotating_calipers": ["convex_hull"],
    "difference_array":  ["prefix_sum"],
    "discretization":    ["prefix_sum"],
    "coordinate_compression": ["two_pointers"],
}

# A few terms with their aliases; a deployment passes its own dictionary.
TERMS: dict[str, list[str]] = {
    "动态规划": ["DP", "状态转移", "最优子结构", "无后效性", "dynamic programming", "线性DP", "区间DP", "dyn_prog"],
    "图论": ["graph theory", "graph", "图算法"],
    "Dijkstra": ["最短路", "非负边权", "优先队列优化", "单源最短路径", "堆优化Dijkstra", "dijkstra"],
    "最小生成树": ["MST", "Prim", "Kruskal", "最小瓶颈路", "minimum_spanning_tree"],
}


def tag_category(spark: SparkSession, categories: dict[str, list[str]] = CATEGORIES) -> DataFrame:
    return spark.createDataFrame([(t, c) for c, tags in categories.items() for t in tags], "tag string, category string")


def prerequisites(spark: SparkSession, graph: dict[str, list[str]] = PREREQUISITES) -> DataFrame:
    return spark.createDataFrame([(t, p, i) for t, needs in graph.items() for i, p in enumerate(needs)], "tag string, needs string, position int")


def terms(spark: SparkSession, dictionary: dict[str, list[str]] = TERMS) -> DataFrame:
    return spark.createDataFrame([(t, a) for t, aliases in dictionary.items() for a in aliases], "term string, alias string")


#: English slugs of one judge's tags.
TAG_SLUGS = {
    "字符串": "string", "动态规划": "dynamic-programming", "递归": "recursion", "数学": "math", "数组": "array", "哈希表": "hash-table", "二分查找": "binary-search", "贪心": "greedy", "树": "tree",
    "深度优先搜索": "dfs", "广度优先搜索": "bfs", "双指针": "two-pointers", "位运算": "bit-manipulation", "回溯": "backtracking", "栈": "stack", "堆（优先队列）": "heap", "排序": "sorting", "模拟": "simulation",
    "图": "graph", "链表": "linked-list", "分治": "divide-and-conquer", "滑动窗口": "sliding-window", "字典树": "trie", "并查集": "union-find", "前缀和": "prefix-sum",
}
