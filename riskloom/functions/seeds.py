"""The seed rows of places, centres, entities, relations and past events. A row a line, fields by |."""

from __future__ import annotations

#: place | latitude | longitude | whether it lies at a border
PLACES = """
仰光省|16.87|96.20|
曼德勒省|21.97|96.08|
内比都|19.76|96.07|
掸邦|21.50|98.00|border
克钦邦|25.00|97.50|border
克伦邦|17.00|97.75|border
钦邦|21.50|93.50|border
克耶邦|19.50|97.50|
孟邦|16.30|97.70|
若开邦|20.50|93.20|border
勃固省|18.00|96.50|
马圭省|20.00|95.00|
实皆省|23.50|95.00|
德林达依省|12.25|99.00|
伊洛瓦底省|15.50|95.50|
"""

#: centre | latitude | longitude | weight
CENTERS = """
中缅边境(瑞丽)|24.01|97.85|1.0
皎漂港|19.43|93.55|0.9
内比都|19.76|96.07|0.8
泰缅边境(妙瓦底)|16.69|98.50|0.7
仰光|16.87|96.20|0.75
"""

#: name | type | aliases, by comma
ENTITIES = """
缅甸|Country|
中国|Country|
印度|Country|
泰国|Country|
美国|Country|
日本|Country|
东盟|Organization|
联合国|Organization|
缅甸国防军|Organization|缅军,Tatmadaw
民族团结政府|Organization|NUG
人民防卫军|Organization|PDF
克钦独立军|Organization|KIA
掸邦军|Organization|SSA
克伦民族联盟|Organization|KNU
若开军|Organization|AA
德昂民族解放军|Organization|TNLA
缅甸民族民主同盟军|Organization|MNDAA
三兄弟联盟|Organization|Three Brotherhood Alliance
敏昂莱|Person|
昂山素季|Person|
仰光|Location|
内比都|Location|
掸邦|Location|
克钦邦|Location|
若开邦|Location|
腊戍|Location|
皎漂港|Location|
中缅油气管道|Location|
军事冲突|EventType|
政变|EventType|
人道主义危机|EventType|
经济制裁|EventType|
难民危机|EventType|
停火谈判|EventType|
"""

#: source | relation | target
RELATIONS = """
缅甸国防军|CONFLICT_WITH|人民防卫军
缅甸国防军|CONFLICT_WITH|克钦独立军
缅甸国防军|CONFLICT_WITH|掸邦军
缅甸国防军|CONFLICT_WITH|克伦民族联盟
缅甸国防军|CONFLICT_WITH|若开军
三兄弟联盟|CONFLICT_WITH|缅甸国防军
缅甸民族民主同盟军|CONFLICT_WITH|缅甸国防军
德昂民族解放军|CONFLICT_WITH|缅甸国防军
人民防卫军|AFFILIATED_WITH|民族团结政府
克钦独立军|COOPERATE_WITH|三兄弟联盟
缅甸民族民主同盟军|MEMBER_OF|三兄弟联盟
德昂民族解放军|MEMBER_OF|三兄弟联盟
若开军|COOPERATE_WITH|三兄弟联盟
中国|ECONOMIC_PARTNER|缅甸
中国|INVESTS_IN|皎漂港
中国|INVESTS_IN|中缅油气管道
美国|SANCTIONS|缅甸
美国|SANCTIONS|缅甸国防军
联合国|MONITORS|缅甸
东盟|DIPLOMATIC_PRESSURE|缅甸
泰国|REFUGEE_HOST|缅甸
印度|BORDER_RELATION|缅甸
日本|AID_PROVIDER|缅甸
敏昂莱|LEADS|缅甸国防军
敏昂莱|BASED_IN|内比都
昂山素季|SYMBOLIC_LEADER|民族团结政府
缅甸国防军|PERPETRATED|政变
政变|TRIGGERED|军事冲突
军事冲突|CAUSES|难民危机
军事冲突|CAUSES|人道主义危机
克钦独立军|OPERATES_IN|克钦邦
若开军|OPERATES_IN|若开邦
缅甸民族民主同盟军|OPERATES_IN|掸邦
缅甸民族民主同盟军|OPERATES_IN|腊戍
经济制裁|AFFECTS|缅甸
中国|TRADE_PARTNER|缅甸
"""

#: date | type | place | severity, 1 to 5
PAST_EVENTS = """
2020-01-15|外交|内比都|2
2020-02-20|经济|皎漂|2
2020-03-23|公共卫生|全国|3
2020-09-09|军事冲突|若开邦|4
2020-11-08|政治|全国|3
2021-02-01|政变|内比都|5
2021-02-06|抗议|仰光|3
2021-02-28|暴力镇压|全国|5
2021-03-27|军事|内比都|3
2021-04-16|政治|未公开|3
2021-05-05|武装|全国|4
2021-06-01|军事冲突|克钦邦|4
2021-09-07|政治|未公开|4
2021-12-24|人道危机|克耶邦|5
2022-01-20|军事冲突|实皆省|4
2022-03-15|经济制裁|国际|3
2022-05-01|人道危机|全国|4
2022-07-25|政治|仰光|4
2022-09-15|军事冲突|克伦邦|4
2022-11-01|外交|金边|2
2023-01-15|军事冲突|马圭省|4
2023-03-28|人道危机|实皆省|5
2023-05-14|自然灾害|全国|4
2023-08-01|经济|掸邦|3
2023-10-27|军事冲突|掸邦北部|5
2023-10-28|军事冲突|腊戍|5
2023-11-03|军事冲突|掸邦|4
2023-11-11|外交|昆明|3
2023-12-15|人道危机|掸邦|4
2024-01-12|外交|昆明|3
2024-02-01|政治|全国|3
2024-02-13|征兵|全国|4
2024-03-07|军事冲突|若开邦|5
2024-03-24|军事冲突|克伦邦|5
2024-04-15|人道危机|全国|5
2024-05-20|军事冲突|曼德勒|4
2024-06-15|军事冲突|皎漂|5
2024-07-01|人道危机|泰缅边境|4
2024-08-03|军事冲突|腊戍|5
2024-09-15|外交|纽约|3
2024-10-01|经济|皎漂|4
2025-01-15|军事冲突|全国|5
2025-02-01|政治|内比都|3
2025-03-01|人道危机|全国|5
2025-04-15|经济|东南亚|3
2025-06-01|外交|区域|3
2025-08-15|军事冲突|克钦邦|4
2025-10-01|政治|区域|3
"""


def rows(text: str) -> list[list[str]]:
    return [line.split("|") for line in text.strip().split("\n")]
