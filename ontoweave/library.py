"""Registered functions of every domain over the objects of a repository."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ontoweave.functions import text as tx
from ontoweave.library_schemes import register_schemes
from ontoweave.operators import filters, graph, links, retrieval
from ontoweave.operators.geo import EARTH_M, within_range
from ontoweave.plans import alarms, answers, cases, docgraph, documents, emergency, evidence, grid, payroll
from ontoweave.registry import FunctionRegistry, register_launch, register_lookups, register_missing, register_toll
from ontoweave.repository import ObjectRepository
from ontoweave.session import cut_lineage


def _either(repo: ObjectRepository, key: str, value: str, kinds: list[str], tag: str) -> DataFrame:
    """The row with this id from the first object type that has it, with the type's name."""
    ids = repo.spark.createDataFrame([(value,)], f"{key} string")
    rows = [(k, repo.query(k, {key: value}), key) for k in kinds]
    names = list(dict.fromkeys(c for _, df, _ in rows for c in df.columns if c != key))
    full = [(k, df.select(key, *[(F.col(c) if c in df.columns else F.lit(None)).alias(c) for c in names]), key) for k, df, _ in rows]
    return links.resolve_in_order(ids, key, full, names).withColumnRenamed("object_type", tag).filter(F.col(tag).isNotNull())


def register_emergency(registry: FunctionRegistry) -> None:
    def event(repo, event_id, **_):
        return _either(repo, "event_id", event_id, ["DisasterEvent", "AccidentEvent"], "event_type")

    def affected(repo, event_id, radius_km=5.0, **_):
        sites = emergency.facilities([
            ("RoadSegment", repo.df("RoadSegment"), "segment_id", "road_name"), ("Bridge", repo.df("Bridge"), "bridge_id", "name"),
            ("Tunnel", repo.df("Tunnel"), "tunnel_id", "name"),
        ])
        return emergency.affected_facilities(event(repo, event_id), sites, radius_km or 5.0)

    functions = {
        "get_event": event, "get_affected_facilities": affected,
        "get_depots_in_range": lambda repo, lng, lat, radius_km=100.0, **_: emergency.depots_in_range(repo.df("EmergencyDepot"), lng, lat, radius_km),
        "get_rescue_teams_in_range": lambda repo, lng, lat, radius_km=100.0, **_: emergency.rescue_teams_in_range(repo.df("RescueTeam"), lng, lat, radius_km),
        "get_drones_in_range": lambda repo, lng, lat, radius_km=50.0, **_: emergency.drones_in_range(repo.df("Drone"), repo.df("DroneBase"), lng, lat, radius_km),
        "get_operators_available": lambda repo, **_: repo.query("DroneOperator", {"available": 1}),
    }
    for name, fn in functions.items():
        registry.register(name, fn)


def register_grid(registry: FunctionRegistry) -> None:
    def request(repo, request_id, **_):
        return _either(repo, "request_id", request_id, ["AccessRequest", "ExpandRequest"], "request_type")

    def with_columns(df: DataFrame, *names: str) -> DataFrame:
        return df.withColumns({n: F.lit("") for n in names if n not in df.columns})

    def source_check(repo, request_id, **_):
        row = with_columns(request(repo, request_id), "target_source_structure", "source_structure", "original_source_structure")
        return grid.validate_source_requirement(row, repo.df("SourceRequirement"))

    def search(repo, request_id, point_types="", **_):
        row = with_columns(request(repo, request_id), "preferred_point_types")
        if point_types:
            row = row.withColumn("preferred_point_types", F.lit(point_types))
        return grid.search_sources(row, repo.df("AccessPoint"))[0]

    def screen(repo, request_id, point_ids, per_path_capacity_kva, **_):
        wanted = [p.strip() for p in point_ids.split(",") if p.strip()]
        points = repo.df("AccessPoint").filter(F.col("point_id").isin(wanted)).withColumn("per_path_capacity_kva", F.lit(float(per_path_capacity_kva)))
        return grid.filter_sources(points, repo.df("Feeder"), repo.df("MainTransformer"))

    def compose(repo, request_id, source_structure, point_ids="", **_):
        points = repo.df("AccessPoint")
        if point_ids:
            points = points.filter(F.col("point_id").isin([p.strip() for p in point_ids.split(",") if p.strip()]))
        place = request(repo, request_id).first()
        if place is None:
            raise ValueError(f"unknown request {request_id!r}")
        # Every point is a candidate: one centre, so distances are a plain projection over the points.
        near = within_range(points, place["lng"], place["lat"], 3.2 * EARTH_M, EARTH_M, 1, "distance_m").withColumn("request_id", F.lit(request_id))
        plans = grid.compose_single(near) if source_structure == grid.SINGLE else grid.compose_dual(near, repo.df("Feeder"), source_structure)
        return repo.replace_all("AccessPlan", plans)

    def score(repo, request_id, **_):
        return grid.score_plans(repo.query("AccessPlan", {"request_id": request_id}).select(
            "plan_id", "request_id", "source_structure", "operation_mode", "point_ids", "total_distance_m"
        ), repo.df("AccessPoint"), repo.df("Feeder"))

    def move(kind: str, key: str, switches: str, feeder_rule: bool):
        rate, rated = ("max_load_rate", F.lit(1.0)) if feeder_rule else ("load_rate", F.col("rated_capacity_kva").cast("double"))

        def run(repo, request_id, required_capacity_kva, **params):
            source = params[f"source_{key}"]
            need = repo.spark.createDataFrame([(request_id, source, float(required_capacity_kva))], "request_id string, source string, need double")
            units = repo.df(kind).select(
                F.col(key).alias("unit_id"), F.col(rate).alias("load_rate"), F.col("openable_capacity_kva").cast("double").alias("openable"), rated.alias("rated")
            )
            moved = cut_lineage(grid.transfer_load(need, grid.ties(repo.df(switches), f"source_{key}", f"target_{key}"), units, feeder_rule))
            store = "FeederLoadTransfer" if feeder_rule else "TransformerLoadTransfer"
            if store in repo.ontology.objects:
                repo.insert(store, moved.filter("target is not null").withColumnsRenamed({"source": f"source_{key}", "target": f"target_{key}"}))
            return moved

        return run

    def supplement(repo, request_id, search_radius_m=2000.0, **_):
        row = with_columns(request(repo, request_id), "target_source_structure")
        checks = source_check(repo, request_id).select("request_id", "required_source_structure", "declared_source_structure")
        needed = row.join(checks, "request_id").select(
            "request_id", "lng", "lat", "capacity_kva", "original_point_id", "declared_source_structure",
            F.coalesce("required_source_structure", "target_source_structure").alias("required_source_structure"))
        return grid.supplementary_sources(needed, repo.df("AccessPoint"), repo.df("Feeder"), repo.df("MainTransformer"), float(search_radius_m or 2000.0))

    def verify(repo, request_id, **_):
        """Stored transfers of a request in the order of their ids."""
        def transfers(name, key):
            return repo.query(name, {"request_id": request_id}).select(
                "request_id", F.col(f"source_{key}").alias("source"), "transfer_capacity_kva", "source_load_rate_after", F.col(repo.object(name).id_field).alias("switch_id"))

        return grid.verify_transfer(
            request(repo, request_id), repo.df("AccessPoint"), repo.df("Feeder"), repo.df("MainTransformer"),
            transfers("FeederLoadTransfer", "feeder_id"), transfers("TransformerLoadTransfer", "transformer_id"), source_check(repo, request_id))

    def ties(object_type: str, key: str):
        columns = [f"source_{key}", f"target_{key}"]
        return lambda repo, **params: repo.df(object_type).filter(filters.either_equals(columns, params[f"source_{key}"]))

    functions = {
        "get_request": request, "validate_source_requirement": source_check, "search_sources": search, "filter_sources": screen,
        "compose_plans": compose, "score_plans": score, "search_supplementary_sources": supplement, "verify_transfer_result": verify,
        "finalize_plans": lambda repo, request_id, **_: grid.finalize_plans(score(repo, request_id)),
        "get_access_points": lambda repo, lng, lat, radius_m=1000.0, **_: within_range(repo.df("AccessPoint"), lng, lat, radius_m, EARTH_M, 1, "distance_m"),
        "get_feeder_tie_switches": ties("FeederTieSwitch", "feeder_id"),
        "get_transformer_tie_switches": ties("TransformerTieSwitch", "transformer_id"),
        "transfer_feeder_load": move("Feeder", "feeder_id", "FeederTieSwitch", True),
        "transfer_transformer_load": move("MainTransformer", "transformer_id", "TransformerTieSwitch", False),
        "new_feeder": lambda repo, request_id, search_radius_m=15000.0, **_: grid.new_feeder(
            request(repo, request_id), repo.df("Substation"), repo.df("MainTransformer"), search_radius_m),
    }
    for name, fn in functions.items():
        registry.register(name, fn)


def register_payroll(registry: FunctionRegistry) -> None:
    """``PayrollEmployeeSnapshot`` carries the run; periods come from the run's row."""
    def run_of(repo, payroll_run_id) -> dict:
        row = repo.query("PayrollRun", {"payroll_run_id": payroll_run_id}, limit=1).first()
        if row is None:
            raise ValueError(f"unknown payroll run {payroll_run_id!r}")
        return row.asDict()

    def snapshots(repo, payroll_run_id, employee_id=""):
        return repo.query("PayrollEmployeeSnapshot", filters.present({"payroll_run_id": payroll_run_id, "employee_id": employee_id}))

    def lines(repo, payroll_run_id, employee_id="", **_):
        period = run_of(repo, payroll_run_id)["payroll_period"]
        return payroll.payroll_lines(
            snapshots(repo, payroll_run_id, employee_id), repo.df("SalarySplitRule"), repo.df("PerformanceGradeRule"), repo.df("PerformanceRecord"),
            repo.query("PayrollAdjustment", {"payroll_run_id": payroll_run_id}), period,
        )

    def paid(repo, payroll_run_id, employee_id="", **_):
        period = run_of(repo, payroll_run_id)["contribution_period"]
        return payroll.contributions(snapshots(repo, payroll_run_id, employee_id), repo.df("SocialInsuranceRule"), repo.df("HousingFundRule"), period)

    def calculate(repo, payroll_run_id, employee_id="", **_):
        ledgers = repo.query("TaxLedger", {"payroll_run_id": payroll_run_id})
        return payroll.calculate_payroll(lines(repo, payroll_run_id, employee_id), paid(repo, payroll_run_id, employee_id), ledgers, repo.df("TaxRateRule"))

    def state(repo, employee_id, as_of_date, **_):
        employees = repo.query("Employee", {"employee_id": employee_id})
        return payroll.employee_state_at(
            employees, repo.df("Person"), repo.df("EmploymentRelationship").join(employees.select("employee_id"), "employee_id", "left_semi"),
            repo.df("SalaryProfile").join(employees.select("employee_id"), "employee_id", "left_semi"), repo.df("Company"), as_of_date,
        )

    def snapshot(repo, payroll_run_id, **_):
        names = ["PayrollRun", "PayrollInputSnapshot", "PayrollEmployeeSnapshot", "PayrollLine", "PayrollValidationResult"]
        runs, inputs, people, drafted, found = [repo.df(n) for n in names]
        return payroll.snapshot_status(runs.filter(F.col("payroll_run_id") == payroll_run_id), inputs, people, drafted, found)

    functions = {
        "build_payroll_snapshot": snapshot, "generate_payroll_lines": lines, "calculate_contributions": paid, "calculate_payroll": calculate, "resolve_employee_state_at": state,
        "resolve_rules_at": lambda repo, company_id, period, **_: payroll.rules_at(
            repo.query("Company", {"company_id": company_id}), repo.df("SocialInsuranceRule"), repo.df("HousingFundRule"), period),
    }
    for name, fn in functions.items():
        registry.register(name, fn)


def register_alarms(registry: FunctionRegistry) -> None:
    def flagged(repo, event_text, station_name="", **_):
        text = repo.spark.createDataFrame([("chain", event_text, station_name)], "chain_id string, event_text string, station_name string")
        return alarms.with_flags(alarms.parse_events(text))

    def sections(repo, query):
        """Sections that answer the searches of a chain: a hit of any search counts, with its best score."""
        return evidence.merged_searches(repo.df("EvidenceChunk"), evidence.scenario_searches(query, "diagnosis"), True)

    def judged(repo, event_text, station_name="", evidence_query="", limit_evidence=cases.CASE_SECTIONS, **_):
        """Judgement of the chain with its facts, triggers and references."""
        found = sections(repo, evidence_query or event_text)
        if "station" not in found.columns:
            found = found.withColumn("station", F.lit(""))
        return cases.conclusions(cases.judge_cases(flagged(repo, event_text, station_name), found, int(limit_evidence or cases.CASE_SECTIONS)))

    def context(repo, event_text, station_name="", **asked):
        """Facts and references of the chain with its events by kind and its timeline; the events are stored."""
        events = flagged(repo, event_text, station_name)
        if "StationEvent" in repo.ontology.objects:
            repo.insert("StationEvent", events.join(repo.df("StationEvent").select("event_id"), "event_id", "left_anti"))
        case = judged(repo, event_text, station_name, **asked).drop("reason", "description", "judged_type", "event_nature", "risk_level")
        return case.join(cases.case_events(events), "chain_id")

    def conclude(repo, event_text, **asked):
        """Conclusions as stored: one row per conclusion id, however often the same case is judged."""
        rows = cases.stored_conclusions(judged(repo, event_text, **asked))
        repo.insert("EventConclusion", rows.join(repo.df("EventConclusion").select("conclusion_id"), "conclusion_id", "left_anti"))
        return rows

    functions = {
        "build_substation_case_context": context, "judge_substation_case": judged, "format_substation_conclusion": conclude,
        "parse_substation_events": flagged,
        "assess_substation_event_chain": lambda repo, event_text, **_: alarms.judge(alarms.chain_features(flagged(repo, event_text))),
        "search_substation_evidence": lambda repo, query, limit=8, **_: evidence.scored_searches(
            repo.df("EvidenceChunk"), [(query, "")], False, int(limit or 8)),
        "prepare_substation_answer_context": lambda repo, query, limit_evidence=5, **_: evidence.answer_context(repo.df("EvidenceChunk"), query, int(limit_evidence or 5)),
    }
    for name, fn in functions.items():
        registry.register(name, fn)


def register_documents(registry: FunctionRegistry) -> None:
    def focus(repo, document_id):
        return repo.query("Document", {"document_id": document_id}).select("document_id")

    def texts(repo):
        """Documents with their whole text: their own, else their chunks in the order of their numbers."""
        rows = repo.df("Document")
        if "text" in rows.columns:
            return rows
        parts = F.array_sort(F.collect_list(F.struct(chunk_number(), "chunk_id", "content")))  # of one document
        whole = repo.df("DocumentChunk").groupBy("document_id").agg(F.array_join(F.transform(parts, lambda p: p["content"]), "\n").alias("text"))
        return rows.join(whole, "document_id", "left")

    def chunk_number():
        return F.coalesce(F.regexp_extract("chunk_id", r"(\d+)$", 1).try_cast("bigint"), F.lit(0)).alias("ordinal")

    def statistics(repo):
        """Term statistics: stored ones, else from the documents."""
        if "TermStatistic" in repo.ontology.objects:
            return repo.df("TermStatistic")
        rows = texts(repo)
        return documents.term_statistics(documents.document_terms(rows), rows)

    def chosen(repo, category="", agency="", doc_type=""):
        chunks = repo.df("DocumentChunk")
        if category or agency or doc_type:
            chunks = chunks.join(documents.list_documents(repo.df("Document"), category or "", agency or "", doc_type or "").select("document_id"), "document_id", "left_semi")
        return chunks

    def recalled(chunks, query, tokens):
        hits = retrieval.recall(chunks, query, tokens, tx.anchor_terms(query))
        return hits.withColumn("snippet", tx.snippet(F.col("content"), query, tokens))

    def similar_chunks(repo, query_vector, min_similarity):
        """(chunk_id, similarity) of every chunk vector at or above the threshold; none without vectors or a query vector."""
        if not query_vector or "ChunkVector" not in repo.ontology.objects:
            return None
        asked = retrieval.normalize(F.array(*[F.lit(float(x)) for x in query_vector]))
        return repo.df("ChunkVector").select("chunk_id", retrieval.dot(retrieval.normalize(F.col("vector")), asked).alias("similarity")).filter(
            F.col("similarity") >= float(min_similarity))

    def found(repo, query, category="", agency="", doc_type="", semantic=False, query_vector=None, min_similarity=0.0):
        """Hits of the lexical recall, with the similar chunks merged in where asked."""
        chunks, tokens = chosen(repo, category, agency, doc_type), tx.query_tokens(query)
        hits = recalled(chunks, query, tokens)
        similar = similar_chunks(repo, query_vector, min_similarity) if semantic else None
        if similar is None:
            return hits
        return retrieval.merge_semantic(hits, chunks.withColumn("snippet", tx.snippet(F.col("content"), query, tokens)), similar)

    def ranked(hits, profile):
        return retrieval.rerank(hits, profile, [-F.round("score", 6), F.col("chunk_id")])

    def profile_of(repo, query):
        return documents.query_profile(query, statistics(repo), repo.df("Document").count(), tx.query_tokens(query))

    def search(repo, query, category="", agency="", doc_type="", limit=8, rerank=False, semantic=False, query_vector=None, min_similarity=0.0, **_):
        """Best chunks with the text around the hit; with ``rerank`` the best documents by the query's profile.

        ``semantic`` merges the chunks whose stored vectors (object ChunkVector) are similar to ``query_vector``;
        without vectors it is the lexical search. Every hit is ranked.
        """
        hits = found(repo, query, category, agency, doc_type, semantic, query_vector, min_similarity)
        if not rerank:
            return hits.orderBy(F.col("score").desc(), "chunk_id").limit(int(limit or 8))
        return ranked(hits, profile_of(repo, query)).orderBy(F.round("related_score", 6).desc(), "document_id").limit(int(limit or 8))

    def related(repo, seed_path="", seed_title="", query_hint="", limit=10, **_):
        """Documents related to a seed: its strongest terms recall, its profile ranks; the seed itself is left out."""
        wanted = filters.present({"path": seed_path, "title__like": seed_title})
        if not wanted:
            raise ValueError("find_related_documents: name a seed by path or title")
        first = repo.query("Document", wanted).orderBy(F.length("path"), "path").select("document_id").limit(1)
        seed = cut_lineage(texts(repo).join(first, "document_id", "left_semi"))
        profile = documents.seed_profile(seed, statistics(repo), repo.df("Document").count(), tx.query_tokens(query_hint or ""))
        if not profile:
            raise ValueError("find_related_documents: no such seed, or one without terms")
        terms = [t for t, _, _ in profile[:documents.RECALLED_TERMS]]
        others = repo.df("DocumentChunk").join(seed.select("document_id"), "document_id", "left_anti")
        return ranked(recalled(others, " ".join(terms), terms), profile).orderBy(F.round("related_score", 6).desc(), "document_id").limit(int(limit or 10))

    def prepare(repo, query, limit_docs=6, max_chars_per_doc=4000, include_relations=True, semantic=False, query_vector=None, min_similarity=0.0, **_):
        """Documents to read for a question with their leading chunks: ranked, related and of the asked years."""
        if not (query or "").strip():
            raise ValueError("prepare_answer_context: the question is empty")
        rows = texts(repo)
        sized = rows if "char_count" in rows.columns else rows.withColumn("char_count", F.length("text"))
        by_document = ranked(found(repo, query), profile_of(repo, query))
        # The ranking is read three times: by the fusion, for the seeds of relations, and to keep them apart.
        hits = cut_lineage(by_document.select("document_id", F.col("best_chunk_id").alias("chunk_id"), F.col("related_score").alias("score")))
        close = similar_chunks(repo, query_vector, min_similarity) if semantic else None
        if close is not None:
            close = close.join(repo.df("DocumentChunk").select("chunk_id", "document_id"), "chunk_id").select("document_id", "similarity")
        chunks = repo.df("DocumentChunk").select("document_id", "chunk_id", "content", chunk_number())
        return answers.prepare_answer_context(
            hits, [F.col("document_id")], sized.select("document_id", "title", "char_count"), chunks, documents.best_year(documents.document_metadata(sized)),
            tx.query_tokens(query), documents.asked_years(query), close, repo.df("DocumentRelation") if include_relations else None,
            int(limit_docs or 6), int(max_chars_per_doc or 4000),
        ).orderBy(*answers.reading_order())

    def read(repo, document_id="", path="", chunk_id="", heading="", max_chars=6000, **_):
        """Leading chunks of the asked document that fit the budget, with their text, in the order of their numbers."""
        wanted = filters.present({"document_id": document_id, "path": path, "chunk_id": chunk_id, "heading__like": heading})
        if not wanted:
            raise ValueError("read_document: name a document, path, chunk or heading")
        number = F.coalesce(F.regexp_extract("chunk_id", r"(\d+)$", 1).try_cast("bigint"), F.lit(0))
        order = Window.partitionBy("document_id").orderBy(number, "chunk_id").rowsBetween(Window.unboundedPreceding, 0)
        sized = repo.query("DocumentChunk", wanted).withColumn("running_chars", F.sum(F.length("content")).over(order))
        return sized.filter(F.col("running_chars") <= int(max_chars or 6000)).orderBy("document_id", "running_chars")

    def edges(repo, relation_types="", min_confidence=0.0):
        rows = repo.df("DocumentRelation").filter(F.col("confidence") >= float(min_confidence or 0.0))
        wanted = [t.strip() for t in (relation_types or "").split(",") if t.strip()]
        rows = rows.filter(F.col("relation_type").isin(wanted)) if wanted else rows
        return rows.select(
            F.col("source_document_id").alias("src"), F.col("target_document_id").alias("dst"), F.col("relation_type").alias("label"), docgraph.edge_score().alias("score"))

    def placed(repo, document_id, path, title_like, name):
        wanted = filters.present({"document_id": document_id, "path": path, "title__like": title_like})
        return repo.query("Document", wanted).select(F.col("document_id").alias(name)) if wanted else None

    def paths(repo, start_document_id="", start_path="", start_title_like="", end_document_id="", end_path="", end_title_like="", relation_types="",
              direction="both", max_depth=3, limit=10, **_):
        start = placed(repo, start_document_id, start_path, start_title_like, "src")
        if start is None:
            raise ValueError("find_document_relation_paths: name a start document")
        found = graph.bounded_paths(edges(repo, relation_types), start, int(max_depth or 3), direction=direction or "both",
                                    ends=placed(repo, end_document_id, end_path, end_title_like, "dst"))
        scored = found.withColumn("score", F.round(F.col("score") + F.size(F.array_distinct("labels")) * 0.2, 6))
        return scored.orderBy(F.col("score").desc(), "depth", F.array_join("path", ">")).limit(int(limit or 10))

    def analyze(repo, relation_types="", top_n=10, min_confidence=0.0, **_):
        """Degree, rank and community of the best connected documents."""
        arcs = cut_lineage(edges(repo, relation_types, min_confidence).select("src", "dst", F.col("score").alias("weight")))
        joined = graph.degrees(arcs).join(graph.pagerank(arcs), "node").join(graph.modularity_communities(arcs), "node")
        return joined.orderBy(F.col("weighted_degree").desc(), "node").limit(int(top_n or 10))

    functions = {
        "search_documents": search, "find_related_documents": related, "prepare_answer_context": prepare, "read_document": read, "find_document_relation_paths": paths, "analyze_document_graph": analyze,
        "list_documents": lambda repo, category="", agency="", doc_type="", title_like="", limit=100, **_: documents.list_documents(
            repo.df("Document"), category or "", agency or "", doc_type or "", title_like or "", int(limit or 100)),
        "find_document_relations": lambda repo, document_id, direction="both", **_: docgraph.find_relations(
            repo.df("DocumentRelation"), focus(repo, document_id), direction or "both"),
        "expand_document_context": lambda repo, document_id, **_: docgraph.expand_context(repo.df("DocumentRelation"), focus(repo, document_id)),
        "find_document_relation_groups": lambda repo, min_relations=2, max_documents_per_group=8, **_: docgraph.relation_groups(
            repo.df("DocumentRelation"), repo.df("Document"), int(min_relations or 2), int(max_documents_per_group or 8)),
    }
    for name, fn in functions.items():
        registry.register(name, fn)


def remove_documents(tables: dict[str, DataFrame], gone: DataFrame) -> dict[str, DataFrame]:
    """Every table of a document store without the rows of the removed documents (``gone``: document_id)."""
    def kept(df: DataFrame) -> DataFrame:
        keys = [c for c in ("document_id", "source_document_id", "target_document_id") if c in df.columns]
        left = reduce(lambda d, k: d.join(gone.select(F.col("document_id").alias(k)), k, "left_anti"), keys, df)
        return left.select(*df.columns)

    return {name: kept(df) for name, df in tables.items()}


def full_registry(repo: ObjectRepository) -> FunctionRegistry:
    """Everything the ontology declares: implemented functions, lookups, and stubs for the rest."""
    registry = FunctionRegistry(repo)
    objects = repo.ontology.objects
    register_lookups(registry)
    for needed, register in [
        ("TollUnit", register_toll), ("DroneBase", register_emergency), ("AccessPoint", register_grid), ("PowerAccessPoint", register_schemes), ("PayrollRun", register_payroll),
        ("LaunchMission", register_launch), ("EvidenceChunk", register_alarms), ("DocumentRelation", register_documents),
    ]:
        if needed in objects:
            register(registry)
    register_missing(registry)
    return registry
