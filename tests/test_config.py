from issuelens import config as C


def test_dev_scope_and_paths():
    prod = C.EngineConfig(base_path="/data/")
    assert prod.raw_dir == "/data/raw" and prod.collection_dir == "/data/collection"
    assert prod.journals_only_projects == ("openqatests",) and prod.max_text_len == 8192
    dev = prod.dev(C.DEV_PROJECT_ID)
    assert dev.project_ids == ("qesecurity",) and dev.base_path == "/data/dev"
    assert dev.journals_only_projects == () and prod.dev("openqatests").journals_only_projects == ("openqatests",)


def test_fixed_vocabularies():
    assert len(C.PROJECT_ALIASES) == 22 and set(C.PROJECT_ALIASES.values()) == set(C.PROJECT_IDS)
    assert [k for k, _, _ in C.PII_RULES] == ["openqa_url", "email", "ipv4", "hostname"]
