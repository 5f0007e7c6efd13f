"""Rows of lineage for the scripts in ``evidence``, each kind as columns and VALUES.

All but ROLES, which was written from the rules, were printed by the engine and reviewed against the rules.
"""

# fmt: off
STATEMENTS = ("file line_start:INTEGER operation target binding_mode parse_status n_scopes:INTEGER lint", """
('open.sql', 2, 'insert', 'mart.z', 'projection_name_inferred', 'parsed', 1, 'insert_without_columns,select_star'),
('open.sql', 3, 'unknown', 'mart.u', NULL, 'regex_fallback', 0, ''),
('open.sql', 4, 'insert', 'mart.v', 'explicit_target_columns', 'parsed', 1, ''),
('open.sql', 5, 'select', NULL, NULL, 'parsed', 1, ''),
('report.sql', 2, 'create', 'mart.big_orders', 'create_output_schema', 'parsed', 2, ''),
('report.sql', 4, 'create', 'mart.lines', 'create_output_schema', 'parsed', 1, ''),
('report.sql', 5, 'insert', 'mart.report', 'explicit_target_columns', 'parsed', 2, ''),
('report.sql', 7, 'insert', '${env}.final', 'projection_name_inferred', 'parsed', 2, 'insert_without_columns,order_without_limit,select_star'),
('schema.sql', 2, 'declare', 'stage.a', 'explicit_ddl', 'parsed', 0, ''),
('schema.sql', 3, 'declare', 'stage.b', 'create_like', 'parsed', 0, ''),
('schema.sql', 4, 'create', 'mart.x', 'create_output_schema', 'parsed', 1, 'select_star'),
('schema.sql', 5, 'create', 'mart.y', 'create_output_schema', 'parsed', 1, 'select_star'),
('schema.sql', 6, 'insert', 'mart.k', 'explicit_target_columns', 'parsed', 2, ''),
('schema.sql', 7, 'update', 'mart.k', 'no_select_source', 'parsed', 1, ''),
('schema.sql', 8, 'merge', 'mart.k', 'no_select_source', 'parsed', 1, ''),
('schema.sql', 9, 'create', 'mart.c', 'create_output_schema', 'parsed', 1, ''),
('schema.sql', 10, 'create', 'mart.c', 'create_output_schema', 'parsed', 1, '')""")

SCOPES = ("file line_start:INTEGER scope_kind outputs output_contract", """
('open.sql', 2, 'statement', '*', 'partial'),
('open.sql', 4, 'statement', 'x', 'complete'),
('open.sql', 5, 'statement', 'missing', 'complete'),
('report.sql', 2, 'cte', 'o_orderkey,o_custkey,price', 'complete'),
('report.sql', 2, 'statement', 'o_orderkey,c_name,segment,price', 'complete'),
('report.sql', 4, 'statement', 'orderkey,revenue', 'complete'),
('report.sql', 5, 'set_branch', '''none'',s_name,s_acctbal', 'partial'),
('report.sql', 5, 'set_branch', 'segment,c_name,revenue', 'complete'),
('report.sql', 7, 'derived', 'segment,revenue', 'complete'),
('report.sql', 7, 'statement', 'segment,revenue,n', 'complete'),
('schema.sql', 4, 'statement', 'id,name', 'complete'),
('schema.sql', 5, 'statement', 'id,name,up', 'complete'),
('schema.sql', 6, 'statement', '1,''one''', 'partial'),
('schema.sql', 6, 'statement', '2,''two''', 'partial'),
('schema.sql', 7, 'statement', '', 'complete'),
('schema.sql', 8, 'statement', '', 'complete'),
('schema.sql', 9, 'statement', 'a', 'complete'),
('schema.sql', 10, 'statement', 'b', 'complete')""")

RELATIONS = ("file line_start:INTEGER relation_kind relation_name alias", """
('open.sql', 2, 'physical', 'raw.unknown', 'unknown'),
('open.sql', 3, 'physical', 'mart.c', NULL),
('open.sql', 4, 'physical', 'raw.p', 'p'),
('open.sql', 4, 'physical', 'raw.q', 'q'),
('open.sql', 5, 'physical', 'raw.p', 'p'),
('open.sql', 5, 'physical', 'raw.q', 'q'),
('report.sql', 2, 'cte', 'o', 'o'),
('report.sql', 2, 'physical', 'customer', 'c'),
('report.sql', 2, 'physical', 'orders', 'orders'),
('report.sql', 4, 'physical', 'lineitem', 'lineitem'),
('report.sql', 5, 'physical', 'mart.big_orders', 'b'),
('report.sql', 5, 'physical', 'mart.lines', 'l'),
('report.sql', 5, 'physical', 'supplier', 'supplier'),
('report.sql', 7, 'derived', 'r', 'r'),
('report.sql', 7, 'physical', 'mart.report', 'report'),
('schema.sql', 4, 'physical', 'stage.b', 'b'),
('schema.sql', 5, 'physical', 'mart.x', 'x'),
('schema.sql', 7, 'physical', 'mart.k', 'k'),
('schema.sql', 8, 'physical', 'mart.k', 't'),
('schema.sql', 8, 'physical', 'stage.a', 's')""")

COLUMNS = ("file line_start:INTEGER column_ref role relation_name column_name status basis", """
('open.sql', 4, 'raw.p.k', 'join', 'raw.p', 'k', 'resolved', 'alias'),
('open.sql', 4, 'raw.q.k', 'join', 'raw.q', 'k', 'resolved', 'alias'),
('open.sql', 4, 'x', 'projection', NULL, NULL, 'ambiguous', 'ambiguous_unqualified'),
('open.sql', 5, 't.missing', 'projection', NULL, NULL, 'unresolved', 'alias_unresolved'),
('report.sql', 2, '${least}', 'filter', NULL, NULL, 'semantic_parameter', 'semantic_parameter'),
('report.sql', 2, 'c.c_custkey', 'join', 'customer', 'c_custkey', 'resolved', 'alias'),
('report.sql', 2, 'c.c_mktsegment', 'projection', 'customer', 'c_mktsegment', 'resolved', 'alias'),
('report.sql', 2, 'c.c_name', 'projection', 'customer', 'c_name', 'resolved', 'alias'),
('report.sql', 2, 'o.o_custkey', 'join', 'o', 'o_custkey', 'resolved', 'alias'),
('report.sql', 2, 'o.o_orderkey', 'projection', 'o', 'o_orderkey', 'resolved', 'alias'),
('report.sql', 2, 'o.price', 'projection', 'o', 'price', 'resolved', 'alias'),
('report.sql', 2, 'o_custkey', 'projection', 'orders', 'o_custkey', 'resolved', 'single_relation_in_scope'),
('report.sql', 2, 'o_orderkey', 'projection', 'orders', 'o_orderkey', 'resolved', 'single_relation_in_scope'),
('report.sql', 2, 'o_totalprice', 'filter', 'orders', 'o_totalprice', 'resolved', 'single_relation_in_scope'),
('report.sql', 2, 'o_totalprice', 'projection', 'orders', 'o_totalprice', 'resolved', 'single_relation_in_scope'),
('report.sql', 4, 'l_discount', 'projection', 'lineitem', 'l_discount', 'resolved', 'single_relation_in_scope'),
('report.sql', 4, 'l_extendedprice', 'projection', 'lineitem', 'l_extendedprice', 'resolved', 'single_relation_in_scope'),
('report.sql', 4, 'l_orderkey', 'group_by', 'lineitem', 'l_orderkey', 'resolved', 'single_relation_in_scope'),
('report.sql', 4, 'l_orderkey', 'projection', 'lineitem', 'l_orderkey', 'resolved', 'single_relation_in_scope'),
('report.sql', 5, 'b.c_name', 'projection', 'mart.big_orders', 'c_name', 'resolved', 'alias'),
('report.sql', 5, 'b.o_orderkey', 'join', 'mart.big_orders', 'o_orderkey', 'resolved', 'alias'),
('report.sql', 5, 'b.segment', 'projection', 'mart.big_orders', 'segment', 'resolved', 'alias'),
('report.sql', 5, 'l.orderkey', 'join', 'mart.lines', 'orderkey', 'resolved', 'alias'),
('report.sql', 5, 'l.revenue', 'projection', 'mart.lines', 'revenue', 'resolved', 'alias'),
('report.sql', 5, 's_acctbal', 'projection', 'supplier', 's_acctbal', 'resolved', 'single_relation_in_scope'),
('report.sql', 5, 's_name', 'projection', 'supplier', 's_name', 'resolved', 'single_relation_in_scope'),
('report.sql', 7, 'revenue', 'projection', 'mart.report', 'revenue', 'resolved', 'single_relation_in_scope'),
('report.sql', 7, 'revenue', 'window_order', 'r', 'revenue', 'resolved', 'single_relation_in_scope'),
('report.sql', 7, 'segment', 'projection', 'mart.report', 'segment', 'resolved', 'single_relation_in_scope'),
('report.sql', 7, 'segment', 'window_partition', 'r', 'segment', 'resolved', 'single_relation_in_scope'),
('schema.sql', 5, 'name', 'projection', 'mart.x', 'name', 'resolved', 'single_relation_in_scope'),
('schema.sql', 8, 's.id', 'join', 'stage.a', 'id', 'resolved', 'alias'),
('schema.sql', 8, 's.name', 'join', 'stage.a', 'name', 'resolved', 'alias'),
('schema.sql', 8, 't.id', 'join', 'mart.k', 'id', 'resolved', 'alias'),
('schema.sql', 8, 't.name', 'join', 'mart.k', 'name', 'resolved', 'alias')""")

JOINS = ("file line_start:INTEGER join_type condition_kind left_column operator right_column status physical_join_confirmed:BOOLEAN", """
('open.sql', 4, 'inner', 'on', 'raw.p.k', '=', 'raw.q.k', 'confirmed', true),
('open.sql', 5, 'inner', 'cross', NULL, NULL, NULL, 'confirmed', true),
('report.sql', 2, 'inner', 'on', 'customer.c_custkey', '=', 'o.o_custkey', 'confirmed', false),
('report.sql', 5, 'left', 'on', 'mart.lines.orderkey', '=', 'mart.big_orders.o_orderkey', 'confirmed', true)""")

DIRECT = ("file line_start:INTEGER branch:INTEGER target_column expression_kind source_relation source_column status origin_status", """
('open.sql', 2, 0, NULL, 'wildcard', NULL, NULL, 'partial', 'not_applicable'),
('open.sql', 4, 0, 'a', 'direct_column', NULL, 'x', 'partial', 'unresolved'),
('report.sql', 2, 0, 'c_name', 'direct_column', 'customer', 'c_name', 'confirmed_direct', 'confirmed'),
('report.sql', 2, 0, 'o_orderkey', 'direct_column', 'o', 'o_orderkey', 'confirmed_direct', 'intermediate_not_traced'),
('report.sql', 2, 0, 'price', 'direct_column', 'o', 'price', 'confirmed_direct', 'intermediate_not_traced'),
('report.sql', 2, 0, 'segment', 'normalization_or_cast', 'customer', 'c_mktsegment', 'confirmed_direct', 'confirmed'),
('report.sql', 4, 0, 'orderkey', 'direct_column', 'lineitem', 'l_orderkey', 'confirmed_direct', 'confirmed'),
('report.sql', 4, 0, 'revenue', 'aggregation', 'lineitem', 'l_discount', 'confirmed_direct', 'confirmed'),
('report.sql', 4, 0, 'revenue', 'aggregation', 'lineitem', 'l_extendedprice', 'confirmed_direct', 'confirmed'),
('report.sql', 5, 0, 'name', 'direct_column', 'mart.big_orders', 'c_name', 'confirmed_direct', 'confirmed'),
('report.sql', 5, 0, 'revenue', 'direct_column', 'mart.lines', 'revenue', 'confirmed_direct', 'confirmed'),
('report.sql', 5, 0, 'segment', 'direct_column', 'mart.big_orders', 'segment', 'confirmed_direct', 'confirmed'),
('report.sql', 5, 1, 'name', 'direct_column', 'supplier', 's_name', 'confirmed_direct', 'confirmed'),
('report.sql', 5, 1, 'revenue', 'direct_column', 'supplier', 's_acctbal', 'confirmed_direct', 'confirmed'),
('report.sql', 5, 1, 'segment', 'literal_or_constant', NULL, NULL, 'confirmed_direct', 'not_applicable'),
('report.sql', 7, 0, 'n', 'window_function', 'r', 'revenue', 'inferred_target', 'intermediate_not_traced'),
('report.sql', 7, 0, 'n', 'window_function', 'r', 'segment', 'inferred_target', 'intermediate_not_traced'),
('report.sql', 7, 0, 'revenue', 'direct_column', 'r', 'revenue', 'inferred_target', 'intermediate_not_traced'),
('report.sql', 7, 0, 'segment', 'direct_column', 'r', 'segment', 'inferred_target', 'intermediate_not_traced'),
('schema.sql', 4, 0, 'id', 'direct_column', 'stage.b', 'id', 'confirmed_direct', 'confirmed'),
('schema.sql', 4, 0, 'name', 'direct_column', 'stage.b', 'name', 'confirmed_direct', 'confirmed'),
('schema.sql', 5, 0, 'id', 'direct_column', 'mart.x', 'id', 'confirmed_direct', 'confirmed'),
('schema.sql', 5, 0, 'name', 'direct_column', 'mart.x', 'name', 'confirmed_direct', 'confirmed'),
('schema.sql', 5, 0, 'up', 'normalization_or_cast', 'mart.x', 'name', 'confirmed_direct', 'confirmed'),
('schema.sql', 6, 0, 'id', 'literal_or_constant', NULL, NULL, 'confirmed_direct', 'not_applicable'),
('schema.sql', 6, 0, 'name', 'literal_or_constant', NULL, NULL, 'confirmed_direct', 'not_applicable'),
('schema.sql', 6, 1, 'id', 'literal_or_constant', NULL, NULL, 'confirmed_direct', 'not_applicable'),
('schema.sql', 6, 1, 'name', 'literal_or_constant', NULL, NULL, 'confirmed_direct', 'not_applicable'),
('schema.sql', 9, 0, 'a', 'literal_or_constant', NULL, NULL, 'confirmed_direct', 'not_applicable'),
('schema.sql', 10, 0, 'b', 'literal_or_constant', NULL, NULL, 'confirmed_direct', 'not_applicable')""")

RECURSIVE = ("file line_start:INTEGER branch:INTEGER target_column terminal_kind source_relation source_column depth:INTEGER status", """
('open.sql', 2, 0, NULL, 'expression_without_column', NULL, '*', 0, 'partial'),
('open.sql', 4, 0, 'a', 'unresolved', NULL, 'x', 0, 'partial'),
('report.sql', 2, 0, 'c_name', 'column', 'customer', 'c_name', 0, 'confirmed'),
('report.sql', 2, 0, 'o_orderkey', 'column', 'orders', 'o_orderkey', 1, 'confirmed'),
('report.sql', 2, 0, 'price', 'column', 'orders', 'o_totalprice', 1, 'confirmed'),
('report.sql', 2, 0, 'segment', 'column', 'customer', 'c_mktsegment', 0, 'confirmed'),
('report.sql', 4, 0, 'orderkey', 'column', 'lineitem', 'l_orderkey', 0, 'confirmed'),
('report.sql', 4, 0, 'revenue', 'column', 'lineitem', 'l_discount', 0, 'confirmed'),
('report.sql', 4, 0, 'revenue', 'column', 'lineitem', 'l_extendedprice', 0, 'confirmed'),
('report.sql', 5, 0, 'name', 'column', 'mart.big_orders', 'c_name', 0, 'confirmed'),
('report.sql', 5, 0, 'revenue', 'column', 'mart.lines', 'revenue', 0, 'confirmed'),
('report.sql', 5, 0, 'segment', 'column', 'mart.big_orders', 'segment', 0, 'confirmed'),
('report.sql', 5, 1, 'name', 'column', 'supplier', 's_name', 0, 'confirmed'),
('report.sql', 5, 1, 'revenue', 'column', 'supplier', 's_acctbal', 0, 'confirmed'),
('report.sql', 5, 1, 'segment', 'expression_without_column', NULL, '''none''', 0, 'confirmed'),
('report.sql', 7, 0, 'n', 'column', 'mart.report', 'revenue', 1, 'inferred_target'),
('report.sql', 7, 0, 'n', 'column', 'mart.report', 'segment', 1, 'inferred_target'),
('report.sql', 7, 0, 'revenue', 'column', 'mart.report', 'revenue', 1, 'inferred_target'),
('report.sql', 7, 0, 'segment', 'column', 'mart.report', 'segment', 1, 'inferred_target'),
('schema.sql', 4, 0, 'id', 'column', 'stage.b', 'id', 0, 'confirmed'),
('schema.sql', 4, 0, 'name', 'column', 'stage.b', 'name', 0, 'confirmed'),
('schema.sql', 5, 0, 'id', 'column', 'mart.x', 'id', 0, 'confirmed'),
('schema.sql', 5, 0, 'name', 'column', 'mart.x', 'name', 0, 'confirmed'),
('schema.sql', 5, 0, 'up', 'column', 'mart.x', 'name', 0, 'confirmed'),
('schema.sql', 6, 0, 'id', 'expression_without_column', NULL, '1', 0, 'confirmed'),
('schema.sql', 6, 0, 'name', 'expression_without_column', NULL, '''one''', 0, 'confirmed'),
('schema.sql', 6, 1, 'id', 'expression_without_column', NULL, '2', 0, 'confirmed'),
('schema.sql', 6, 1, 'name', 'expression_without_column', NULL, '''two''', 0, 'confirmed'),
('schema.sql', 9, 0, 'a', 'expression_without_column', NULL, '1', 0, 'confirmed'),
('schema.sql', 10, 0, 'b', 'expression_without_column', NULL, '1', 0, 'confirmed')""")

GAPS = ("file line_start:INTEGER gap_kind n:BIGINT", """
('open.sql', 2, 'wildcard_projection_unexpanded', 1),
('open.sql', 3, 'parse_failed', 1),
('open.sql', 4, 'column_ambiguous', 2),
('open.sql', 4, 'projection_missing', 1),
('open.sql', 5, 'column_unresolved', 1)""")

KEYS = ("file line_start:INTEGER key_kind relation_name key_columns", """
('open.sql', 3, 'upsert_key', 'mart.u', 'a'),
('report.sql', 7, 'row_number_partition', 'r', 'segment'),
('schema.sql', 8, 'merge_key', 'mart.k', 'id,name')""")

LITERALS = ("file line_start:INTEGER operation target target_column literal", """
('report.sql', 5, 'insert', 'mart.report', 'segment', '''none'''),
('schema.sql', 6, 'insert', 'mart.k', 'id', '1'),
('schema.sql', 6, 'insert', 'mart.k', 'id', '2'),
('schema.sql', 6, 'insert', 'mart.k', 'name', '''one'''),
('schema.sql', 6, 'insert', 'mart.k', 'name', '''two'''),
('schema.sql', 7, 'update', 'mart.k', 'name', '''zero'''),
('schema.sql', 9, 'create', 'mart.c', 'a', '1'),
('schema.sql', 10, 'create', 'mart.c', 'b', '1')""")

PATHS = ("file line_start:INTEGER target_column column_ref operations", """
('open.sql', 4, 'a', 'x', ''),
('report.sql', 2, 'c_name', 'c.c_name', ''),
('report.sql', 2, 'o_orderkey', 'o.o_orderkey', ''),
('report.sql', 2, 'price', 'o.price', ''),
('report.sql', 2, 'segment', 'c.c_mktsegment', 'upper'),
('report.sql', 4, 'orderkey', 'l_orderkey', ''),
('report.sql', 4, 'revenue', 'l_discount', 'sum>multiply>subtract'),
('report.sql', 4, 'revenue', 'l_extendedprice', 'sum>multiply'),
('report.sql', 5, 'name', 'b.c_name', ''),
('report.sql', 5, 'name', 's_name', ''),
('report.sql', 5, 'revenue', 'l.revenue', ''),
('report.sql', 5, 'revenue', 's_acctbal', ''),
('report.sql', 5, 'segment', 'b.segment', ''),
('report.sql', 7, 'n', 'revenue', 'window'),
('report.sql', 7, 'n', 'segment', 'window'),
('schema.sql', 5, 'up', 'name', 'cast:int>upper>trim')""")

CONTRACTS = ("relation_name columns basis status n_definitions:INTEGER", """
('mart.big_orders', 'o_orderkey,c_name,segment,price', 'create_output_schema', 'confirmed', 1),
('mart.c', NULL, 'create_output_schema', 'conflicting', 2),
('mart.lines', 'orderkey,revenue', 'create_output_schema', 'confirmed', 1),
('mart.x', 'id,name', 'create_output_schema', 'confirmed', 1),
('mart.y', 'id,name,up', 'create_output_schema', 'confirmed', 1),
('stage.a', 'id,name', 'explicit_ddl', 'confirmed', 1),
('stage.b', 'id,name', 'create_like', 'confirmed', 1)""")

DEPENDENCIES = ("source target", """
('customer', 'mart.big_orders'),
('lineitem', 'mart.lines'),
('mart.big_orders', 'mart.report'),
('mart.lines', 'mart.report'),
('mart.report', '${env}.final'),
('mart.x', 'mart.y'),
('orders', 'mart.big_orders'),
('stage.b', 'mart.x'),
('supplier', 'mart.report')""")

ACROSS = ("target_ref source_ref depth:INTEGER", """
('${env}.final.n', 'customer.c_mktsegment', 3),
('${env}.final.n', 'lineitem.l_discount', 3),
('${env}.final.n', 'lineitem.l_extendedprice', 3),
('${env}.final.n', 'supplier.s_acctbal', 2),
('${env}.final.revenue', 'lineitem.l_discount', 3),
('${env}.final.revenue', 'lineitem.l_extendedprice', 3),
('${env}.final.revenue', 'supplier.s_acctbal', 2),
('${env}.final.segment', 'customer.c_mktsegment', 3),
('mart.big_orders.c_name', 'customer.c_name', 1),
('mart.big_orders.o_orderkey', 'orders.o_orderkey', 1),
('mart.big_orders.price', 'orders.o_totalprice', 1),
('mart.big_orders.segment', 'customer.c_mktsegment', 1),
('mart.lines.orderkey', 'lineitem.l_orderkey', 1),
('mart.lines.revenue', 'lineitem.l_discount', 1),
('mart.lines.revenue', 'lineitem.l_extendedprice', 1),
('mart.report.name', 'customer.c_name', 2),
('mart.report.name', 'supplier.s_name', 1),
('mart.report.revenue', 'lineitem.l_discount', 2),
('mart.report.revenue', 'lineitem.l_extendedprice', 2),
('mart.report.revenue', 'supplier.s_acctbal', 1),
('mart.report.segment', 'customer.c_mktsegment', 2),
('mart.x.id', 'stage.b.id', 1),
('mart.x.name', 'stage.b.name', 1),
('mart.y.id', 'stage.b.id', 2),
('mart.y.name', 'stage.b.name', 2),
('mart.y.up', 'stage.b.name', 2)""")

JOIN_KEYS = ("column_a column_b n_joins:BIGINT n_statements:BIGINT", """
('customer.c_custkey', 'o.o_custkey', 1, 1),
('mart.big_orders.o_orderkey', 'mart.lines.orderkey', 1, 1),
('raw.p.k', 'raw.q.k', 1, 1)""")

PRODUCERS = ("relation_name n_producers:BIGINT operations status", """
('${env}.final', 1, 'insert', 'unique'),
('mart.big_orders', 1, 'create', 'unique'),
('mart.c', 2, 'create', 'multiple'),
('mart.k', 2, 'insert,merge', 'multiple'),
('mart.lines', 1, 'create', 'unique'),
('mart.report', 1, 'insert', 'unique'),
('mart.v', 1, 'insert', 'unique'),
('mart.x', 1, 'create', 'unique'),
('mart.y', 1, 'create', 'unique'),
('mart.z', 1, 'insert', 'unique')""")

VALUE_SOURCES = ("target target_column terminal_kind source_relation source_column n_branches:BIGINT depth:INTEGER complete:BOOLEAN mapping_kind", """
('${env}.final', 'n', 'column', 'mart.report', 'revenue', 1, 1, true, 'multiple_sources'),
('${env}.final', 'n', 'column', 'mart.report', 'segment', 1, 1, true, 'multiple_sources'),
('${env}.final', 'revenue', 'column', 'mart.report', 'revenue', 1, 1, true, 'single_source'),
('${env}.final', 'segment', 'column', 'mart.report', 'segment', 1, 1, true, 'single_source'),
('mart.big_orders', 'c_name', 'column', 'customer', 'c_name', 1, 0, true, 'single_source'),
('mart.big_orders', 'o_orderkey', 'column', 'orders', 'o_orderkey', 1, 1, true, 'single_source'),
('mart.big_orders', 'price', 'column', 'orders', 'o_totalprice', 1, 1, true, 'single_source'),
('mart.big_orders', 'segment', 'column', 'customer', 'c_mktsegment', 1, 0, true, 'single_source'),
('mart.c', 'a', 'expression_without_column', NULL, '1', 1, 0, true, 'single_source'),
('mart.c', 'b', 'expression_without_column', NULL, '1', 1, 0, true, 'single_source'),
('mart.k', 'id', 'expression_without_column', NULL, '1', 1, 0, true, 'multiple_sources'),
('mart.k', 'id', 'expression_without_column', NULL, '2', 1, 0, true, 'multiple_sources'),
('mart.k', 'name', 'expression_without_column', NULL, '''one''', 1, 0, true, 'multiple_sources'),
('mart.k', 'name', 'expression_without_column', NULL, '''two''', 1, 0, true, 'multiple_sources'),
('mart.lines', 'orderkey', 'column', 'lineitem', 'l_orderkey', 1, 0, true, 'single_source'),
('mart.lines', 'revenue', 'column', 'lineitem', 'l_discount', 1, 0, true, 'multiple_sources'),
('mart.lines', 'revenue', 'column', 'lineitem', 'l_extendedprice', 1, 0, true, 'multiple_sources'),
('mart.report', 'name', 'column', 'mart.big_orders', 'c_name', 1, 0, true, 'multiple_sources'),
('mart.report', 'name', 'column', 'supplier', 's_name', 1, 0, true, 'multiple_sources'),
('mart.report', 'revenue', 'column', 'mart.lines', 'revenue', 1, 0, true, 'multiple_sources'),
('mart.report', 'revenue', 'column', 'supplier', 's_acctbal', 1, 0, true, 'multiple_sources'),
('mart.report', 'segment', 'column', 'mart.big_orders', 'segment', 1, 0, true, 'multiple_sources'),
('mart.report', 'segment', 'expression_without_column', NULL, '''none''', 1, 0, true, 'multiple_sources'),
('mart.v', 'a', 'unresolved', NULL, 'x', 1, 0, false, 'single_source'),
('mart.x', 'id', 'column', 'stage.b', 'id', 1, 0, true, 'single_source'),
('mart.x', 'name', 'column', 'stage.b', 'name', 1, 0, true, 'single_source'),
('mart.y', 'id', 'column', 'mart.x', 'id', 1, 0, true, 'single_source'),
('mart.y', 'name', 'column', 'mart.x', 'name', 1, 0, true, 'single_source'),
('mart.y', 'up', 'column', 'mart.x', 'name', 1, 0, true, 'single_source')""")

DRIVERS = ("target status driver_relation n_columns:BIGINT", """
('${env}.final', 'unique', 'mart.report', 3),
('mart.big_orders', 'ambiguous', NULL, 2),
('mart.c', 'none', NULL, 0),
('mart.k', 'none', NULL, 0),
('mart.lines', 'unique', 'lineitem', 2),
('mart.report', 'ambiguous', NULL, 2),
('mart.v', 'none', NULL, 0),
('mart.x', 'unique', 'stage.b', 2),
('mart.y', 'unique', 'mart.x', 3),
('mart.z', 'none', NULL, 0)""")

CALCULATIONS = ("target target_column statuses sources expression_kinds n_edges:BIGINT", """
('${env}.final', 'n', 'inferred_target', 'r.revenue,r.segment', 'window_function', 2),
('${env}.final', 'revenue', 'inferred_target', 'r.revenue', 'direct_column', 1),
('${env}.final', 'segment', 'inferred_target', 'r.segment', 'direct_column', 1),
('mart.big_orders', 'c_name', 'confirmed_direct', 'customer.c_name', 'direct_column', 1),
('mart.big_orders', 'o_orderkey', 'confirmed_direct', 'o.o_orderkey', 'direct_column', 1),
('mart.big_orders', 'price', 'confirmed_direct', 'o.price', 'direct_column', 1),
('mart.big_orders', 'segment', 'confirmed_direct', 'customer.c_mktsegment', 'normalization_or_cast', 1),
('mart.c', 'a', 'confirmed_direct', '', 'literal_or_constant', 1),
('mart.c', 'b', 'confirmed_direct', '', 'literal_or_constant', 1),
('mart.k', 'id', 'confirmed_direct', '', 'literal_or_constant', 2),
('mart.k', 'name', 'confirmed_direct', '', 'literal_or_constant', 2),
('mart.lines', 'orderkey', 'confirmed_direct', 'lineitem.l_orderkey', 'direct_column', 1),
('mart.lines', 'revenue', 'confirmed_direct', 'lineitem.l_discount,lineitem.l_extendedprice', 'aggregation', 2),
('mart.report', 'name', 'confirmed_direct', 'mart.big_orders.c_name,supplier.s_name', 'direct_column', 2),
('mart.report', 'revenue', 'confirmed_direct', 'mart.lines.revenue,supplier.s_acctbal', 'direct_column', 2),
('mart.report', 'segment', 'confirmed_direct', 'mart.big_orders.segment', 'direct_column,literal_or_constant', 2),
('mart.v', 'a', 'partial', 'x', 'direct_column', 1),
('mart.x', 'id', 'confirmed_direct', 'stage.b.id', 'direct_column', 1),
('mart.x', 'name', 'confirmed_direct', 'stage.b.name', 'direct_column', 1),
('mart.y', 'id', 'confirmed_direct', 'mart.x.id', 'direct_column', 1),
('mart.y', 'name', 'confirmed_direct', 'mart.x.name', 'direct_column', 1),
('mart.y', 'up', 'confirmed_direct', 'mart.x.name', 'normalization_or_cast', 1)""")

ROLES = ("relation_name relation_kind role confidence", """
('${env}.final', 'physical_template', 'output_target', 'confirmed'),
('customer', 'physical', 'external_source', 'confirmed'),
('lineitem', 'physical', 'external_source', 'confirmed'),
('mart.big_orders', 'physical', 'internal_intermediate', 'confirmed'),
('mart.c', 'physical', 'internal_intermediate', 'confirmed'),
('mart.k', 'physical', 'internal_intermediate', 'confirmed'),
('mart.lines', 'physical', 'internal_intermediate', 'confirmed'),
('mart.report', 'physical', 'internal_intermediate', 'confirmed'),
('mart.u', 'physical', 'output_target', 'confirmed'),
('mart.v', 'physical', 'output_target', 'confirmed'),
('mart.x', 'physical', 'internal_intermediate', 'confirmed'),
('mart.y', 'physical', 'output_target', 'confirmed'),
('mart.z', 'physical', 'output_target', 'confirmed'),
('o', 'cte', 'internal_intermediate', 'confirmed'),
('orders', 'physical', 'external_source', 'confirmed'),
('r', 'derived', 'internal_intermediate', 'confirmed'),
('raw.p', 'physical', 'external_source', 'confirmed'),
('raw.q', 'physical', 'external_source', 'confirmed'),
('raw.unknown', 'physical', 'external_source', 'confirmed'),
('stage.a', 'physical', 'internal_intermediate', 'confirmed'),
('stage.b', 'physical', 'internal_intermediate', 'confirmed'),
('supplier', 'physical', 'external_source', 'confirmed')""")
