"""The food catalogue as one configuration of the generic operators: its columns, keyword lists and preparation plan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import any_of, is_franchise, parse_name, parse_quantity
from tessera.operators.cleaning import deduplicate, first_match, keyword_class, ladder, names_company, record_groups, sentinel_to_null
from tessera.operators.reports import same_order
from tessera.schema import CUISINES, NOT_APPLICABLE, SNACK
from tessera.sources.vector_store import ModelSpec, StoreError, VectorStore, incompatible, provenance

# Categories and keywords of the catalogue, in their natural order.
MEAL = ["밥류", "면 및 만두류", "국 및 탕류", "찌개 및 전골류", "죽 및 스프류", "볶음류", "구이류", "튀김류", "찜류", "조림류", "전·적 및 부침류"]
SIDE = ["생채·무침류", "나물·숙채류", "김치류", "장아찌·절임류", "젓갈류", "장류, 양념류"]
DESSERT = ["빵 및 과자류", "유제품류 및 빙과류"]
BEVERAGE = ["음료 및 차류"]
MEAL_BREAD = ["피자", "버거", "햄버거", "샌드위치", "핫도그", "토스트"]
COOKING = ["볶음류", "조림류", "구이류", "튀김류", "찜류", "전·적 및 부침류"]
SIDE_STRONG = ["장조림", "맛탕", "뱅어포", "콘치즈", "떡강정"]
SIDE_WORDS = [
    "멸치", "마늘쫑", "미역줄기", "꽈리고추", "풋고추", "건새우", "오징어채", "오징어포", "파래",
    "김치볶음", "감자", "고구마", "어묵", "양파", "호박", "피망", "버섯", "가지", "우엉", "연근",
    "죽순", "당근", "껍질콩", "콩조림", "콩자반", "땅콩", "다시마", "곤약", "무조림", "메추리알",
    "달걀", "계란", "두부", "쥐포", "김구이", "김튀김", "김부각", "깻잎", "고추조림", "고추전",
    "고추튀김", "소시지", "햄", "베이컨", "런천미트", "미트볼", "완자", "튀각", "부각", "옥수수",
    "더덕", "브로콜리", "콩나물", "유부", "맛살", "채소", "도라지", "쑥", "김말이", "게맛살",
    "양념두부", "고추장볶음", "새우조림", "게조림", "머위", "시금치", "조미 김", "장떡", "배추전",
    "미나리", "메밀전", "파래전", "스크램블드에그", "치즈스틱", "치즈볼", "양미리", "단호박",
    "산적", "수란", "닭발", "닭껍데기", "닭모래집", "꼬막", "가오리", "우유튀김", "식빵튀김",
]
MEAL_WORDS = [
    "밥", "국", "탕", "찌개", "면", "떡볶이", "라볶이", "쫄볶이", "갈비", "불고기", "스테이크",
    "탕수", "돈가스", "까스", "가스", "치킨", "닭튀김", "닭강정", "닭찜", "찜닭", "수육", "족발",
    "동파육", "김치찜", "그라탕", "잡채", "제육", "순대", "곱창", "막창", "대창", "삼겹살", "오겹살",
    "낙지", "주꾸미", "오징어볶음", "오징어불고기", "해물", "마파두부", "감바스", "팔보채", "유산슬",
    "깐풍", "라조기", "난자완스", "멘보샤", "깐쇼", "떡갈비", "훈제오리", "오리", "장어", "폭찹",
    "함박", "닭도리탕", "닭볶음탕", "스튜", "빈대떡", "파전", "김치전", "녹두전", "돼지고기",
    "소고기", "닭고기", "돼지", "닭구이", "닭다리", "닭조림", "아귀", "꽃게", "게찜", "대구", "도미",
    "조기", "고등어", "갈치", "삼치", "꽁치", "가자미", "임연수", "연어", "우럭", "전어", "병어",
    "민어", "동태", "코다리", "황태구이", "굴찜", "바지락", "홍어", "붕어", "메기", "복", "전복",
    "새우구이", "새우튀김", "오징어튀김", "오징어찜", "문어", "세발낙지", "두부김치", "깐풍기",
    "꼬치", "닭날개", "옥돔", "북어", "오믈렛",
]
CUISINE_PATTERNS = (
    ("중식", r"짜장|자장|짬뽕|탕수|깐풍|깐쇼|라조|유산슬|팔보채|마파|양장피|울면|기스면|난자완스|멘보샤|잡탕|잡채밥|마라|훠궈|동파육|꿔바로우|유린기|중식"),
    ("일식", r"초밥|스시|회덮밥|사시미|우동|소바|메밀|돈까스|돈가스|까스|규동|미소|라멘|데리야끼|가라아게|텐동|카츠|카레|하이라이스|오므라이스|롤$|롤\s"),
    ("양식", r"스파게티|파스타|스테이크|함박|햄버거|버거|피자|샌드위치|토스트|오믈렛|스튜|그라탕|리조또|샐러드|핫도그|크로크|수프|스프|폭찹|나폴리탄"),
    ("동남아", r"쌀국수|분짜|팟타이|월남쌈|똠얌|나시|커리"),
    ("분식", r"떡볶이|라볶이|쫄볶이|김밥|라면|쫄면|순대|어묵|핫바|김말이|컵밥"),
)
SNACK_CATEGORIES = ("전·적 및 부침류", "튀김류", "구이류")
SNACK_PATTERN = r"족발|보쌈|골뱅이|닭발|오징어|황태|노가리|먹태|두부김치|계란말이|치킨|닭강정|곱창|막창|대창|삼겹살|육회|나초|소시지|감바스|해물찜|아귀찜|조개|꼬치|안주|부침|전$"
STAPLES = (
    "쌀밥", "잡곡밥", "현미밥", "순 현미밥", "보리밥", "콩밥", "차조밥", "밤밥", "혼합잡곡밥", "기장밥", "수수밥", "흑미밥", "오곡밥",
    "찰밥", "팥밥", "율무밥", "완두콩밥", "귀리밥", "검정콩밥", "강낭콩밥", "감자밥", "고구마밥", "옥수수밥", "누룽지",
)
NUTRIENTS = [
    "에너지(kcal)", "수분(g)", "단백질(g)", "지방(g)", "회분(g)", "탄수화물(g)", "당류(g)",
    "식이섬유(g)", "칼슘(mg)", "철(mg)", "인(mg)", "칼륨(mg)", "나트륨(mg)",
    "비타민 A(μg RAE)", "레티놀(μg)", "베타카로틴(μg)", "티아민(mg)", "리보플라빈(mg)",
    "니아신(mg)", "비타민 C(mg)", "비타민 D(μg)", "콜레스테롤(mg)", "포화지방산(g)",
    "트랜스지방산(g)",
]
KEPT_NUTRIENTS = ["에너지(kcal)", "단백질(g)", "지방(g)", "탄수화물(g)", "당류(g)", "식이섬유(g)", "나트륨(mg)", "콜레스테롤(mg)", "포화지방산(g)"]
COLUMNS = [
    "식품코드", "식품명", "메뉴명", "이름접두어", "온도", "사이즈",
    "메뉴그룹", "식품대분류명", "대표식품명", "식품중분류명",
    "식품기원명", "업체명", "프랜차이즈여부", "출처명", "데이터생성방법명",
    "영양성분함량기준량", "중량값", "중량단위",
    *KEPT_NUTRIENTS,
]
DEDUP_KEYS = ["식품명", "업체명", "영양성분함량기준량", "식품중량", *NUTRIENTS]
UNIT_KEYS = ["메뉴명", "이름접두어", "대표식품명", "식품대분류명", "업체명", "온도"]
UNIT_CARRY = ["식품명", "메뉴명", "이름접두어", "대표식품명", "식품대분류명", "업체명", "온도", "프랜차이즈여부"]


def is_side(representative: Column) -> Column:
    return keyword_class(representative, SIDE_STRONG, SIDE_WORDS, MEAL_WORDS)


def menu_group(category: Column, representative: Column) -> Column:
    """Meal, side, dessert, beverage or other; breads that are a meal and cooked sides are decided last."""
    return ladder(
        (category.isin(MEAL), "식사"),
        (category.isin(SIDE), "반찬"),
        (category.isin(DESSERT), "디저트"),
        (category.isin(BEVERAGE), "음료"),
        ((category == "빵 및 과자류") & representative.isin(MEAL_BREAD), "식사"),
        (category.isin(COOKING) & is_side(representative), "반찬"),
        default="기타",
    )


def is_ambiguous(representative: Column, category: Column) -> Column:
    """A cooked dish that stays a meal although it names a side's word."""
    return F.coalesce(category.isin(COOKING), F.lit(False)) & F.coalesce(representative, F.lit("None")).rlike(any_of(SIDE_WORDS))


def _name_text(name: Column, representative: Column) -> Column:
    return F.concat(F.coalesce(name, F.lit("")), F.lit(" "), F.coalesce(representative, F.lit("")))


def cuisine(name: Column, representative: Column) -> Column:
    return first_match(_name_text(name, representative), CUISINE_PATTERNS, CUISINES[0])


def is_snack(name: Column, representative: Column, category: Column) -> Column:
    return F.coalesce(category.isin(*SNACK_CATEGORIES), F.lit(False)) | _name_text(name, representative).rlike(SNACK_PATTERN)


def is_staple(representative: Column) -> Column:
    return F.coalesce(F.trim(representative), F.lit("")).isin(*STAPLES)


def clean(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Raw rows to (clean rows, map of duplicates): group, name parts, weight, exact deduplication, sentinels, columns."""
    df = raw.withColumn("프랜차이즈여부", names_company(F.col("업체명"), NOT_APPLICABLE))
    df = df.withColumns(
        {
            "메뉴그룹": menu_group(F.col("식품대분류명"), F.col("대표식품명")),
            "_name": parse_name(F.col("식품명"), F.col("프랜차이즈여부")),
            "_weight": parse_quantity(F.col("식품중량")),
        }
    ).withColumns(
        {"메뉴명": F.col("_name.menu"), "이름접두어": F.col("_name.prefix"), "온도": F.col("_name.temperature"), "사이즈": F.col("_name.size"), "중량값": F.col("_weight.value"), "중량단위": F.col("_weight.unit")}
    )
    kept, moved = deduplicate(df, DEDUP_KEYS, "식품코드", ["식품명", "식품기원명", "업체명"])
    kept = sentinel_to_null(kept, ["업체명", "식품중분류명"], NOT_APPLICABLE)
    return kept.select(*(F.col(f"`{c}`") for c in COLUMNS)), moved.withColumnRenamed("kept_code", "대표식품코드")


def meals(clean_rows: DataFrame) -> DataFrame:
    return clean_rows.filter(F.col("메뉴그룹") == "식사")


def units(menu: DataFrame) -> DataFrame:
    """Labelling units: rows that differ only in size or source share one label."""
    out = record_groups(menu, UNIT_KEYS, "식품코드", UNIT_CARRY, fill={"업체명": "비프랜차이즈"})
    return out.withColumn("경계메뉴", is_ambiguous(F.col("대표식품명"), F.col("식품대분류명")))


def with_derived_labels(records: DataFrame, given: DataFrame | None = None) -> DataFrame:
    """``records`` (schema RECORD) with cuisine and snack in their labels and tokens; valid given values come first."""
    rule_cuisine = cuisine(F.col("name"), F.col("representative"))
    rule_snack = F.when(is_snack(F.col("name"), F.col("representative"), F.col("category")), SNACK[0]).otherwise(SNACK[1])
    out = records
    if given is None:
        out = out.withColumns({"_c": F.lit(None).cast("string"), "_s": F.lit(None).cast("string"), "_any": F.lit(False)})
    else:
        out = out.join(given.select("id", F.col("cuisine").alias("_c"), F.col("snack").alias("_s"), F.lit(True).alias("_any")), "id", "left")
    out = out.withColumns({"_c": F.when(F.col("_c").isin(*CUISINES), F.col("_c")).otherwise(rule_cuisine), "_s": F.when(F.col("_s").isin(*SNACK), F.col("_s")).otherwise(rule_snack)})
    old = F.map_filter(F.coalesce("labels", F.create_map().cast("map<string,string>")), lambda k, _: ~k.isin("계열", "안주"))
    labels = F.map_concat(old, F.create_map(F.lit("계열"), F.col("_c"), F.lit("안주"), F.col("_s")))
    extra = F.array_compact(F.array(F.col("_c"), F.when(F.col("_s") == SNACK[0], F.lit("안주"))))
    tokens = F.concat(F.coalesce("tokens", F.array().cast("array<string>")), extra)
    source = F.when(F.col("_any"), "given").otherwise("rule")
    return out.withColumns({"labels": labels, "tokens": tokens, "cuisine_source": source}).drop("_c", "_s", "_any")


def candidates(records: DataFrame, given: DataFrame | None = None, companies: bool = False, staples: bool = False) -> DataFrame:
    """What can be recommended, with derived labels: without companies' records and plain staples unless asked for."""
    rows = records
    if not companies:
        rows = rows.filter(~is_franchise(F.col("company")))
    if not staples:
        rows = rows.filter(~is_staple(F.col("representative")))
    return with_derived_labels(rows, given)


def load_index(
    store: VectorStore, variant: str, spec: ModelSpec, source_files: dict[str, str], given: DataFrame | None = None, companies: bool = False, staples: bool = False
) -> tuple[DataFrame, dict]:
    """(candidates with vectors, where they come from and which were taken) of the one stored table that fits.

    Raises if there is not exactly one, or if encoder or sources have changed since it was stored.
    """
    name = store.find(spec, variant)
    manifest = store.manifest(name)
    if problems := incompatible(manifest, spec, source_files):
        raise StoreError(f"{name} does not fit: " + "; ".join(problems))
    index = candidates(store.load(name), given, companies, staples)
    scope = {"companies": companies, "staples": staples, "n": index.count(), "of": manifest["num_vectors"], "given": 0 if given is None else given.count()}
    return index, provenance(manifest) | {"scope": scope}


def active_index(base: DataFrame, swapped: DataFrame | None, id_: str = "id", position: str = "position") -> tuple[DataFrame, str]:
    """The swapped-in vectors if they hold the same ids in the same order as the current candidates, else the base."""
    if swapped is not None and same_order(base, swapped, id_, position).first()["same"]:
        return swapped, "swapped"
    return base, "base"
