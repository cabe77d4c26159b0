"""DataFrame -> DataFrame operators. Each takes and returns DataFrames; the
only actions are the iterative graph job's loop-control counts, one aggregate of
the containment join and the reliable checkpoints of shared intermediates."""

from .conform import (broken_links, checklist_completion, copied_blocks, documented_vs_actual, extract_links,
                      forbidden_crossings, line_findings, long_texts, modules_without_note, month_index,
                      new_findings, removed_without_deprecation, repeated_lines, task_completion, text_lines,
                      verdict, with_severity)
from .graph import bounded_cycles, component_summary, cyclic_components, witness_cycles
from .impact import (change_lines, change_report, classify_changes, conflict_flags, detect_conflicts,
                     guarded_overwrite, impact_modules, impact_report, map_documents, rate_symbols)
from .inventory import (detect_languages, entry_files, language_tools, languages_by_extension, module_members,
                        modules_from_files, project_name, root_entries, source_dir)
from .mentions import contains_join
from .quality import (check_rows, check_tally, count_by, last_sync, resolve_defaults, status_rollup,
                      validate_rows, with_defaults)
from .snapshot import (diff_snapshots, diff_state, filter_paths, infer_source_files, pair_renames, stale_entries,
                       symbols_from_changes, upsert_state)
from .structure import (boundaries, boundary_matrix, call_edges, core_apis, deep_files, entry_points,
                        export_counts, god_modules, health, issue_rows, module_boundaries, module_dependencies, orphans)

__all__ = [n for n in dir() if not n.startswith("_")]
