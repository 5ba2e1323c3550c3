"""The vendor's industry groups by sector, for ``clean.map_groups``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Industry group names as the vendor writes them (non-breaking spaces and a trailing space included).
SECTOR_GROUPS: dict[str, list[str]] = {
    "technology": [
        "Communication Equipment", "Computer & Office Equipment", "Computer Integrated Systems Design", "Electronic Components & Accessories",
        "Instruments For Measuring & Testing Of Electricity & Electrical Instruments", "Optical Instruments And Lenses", "Radio & Tv Broadcasting & Communications Equipment",
        "Services – Computer Programming And Data Processing", "Services – Management, Public Relations, Consulting", "Special Industry Machinery", "Telephone And Telegraph Apparatus",
        "Wholesale – Electronic Parts & Equipment",
    ],
    "health_care": [
        "Accident And Health Insurance", "Biological Products, Except Diagnostic Substances", "In Vitro, In Vivo Diagnostic Substances", "Lab Analytical Instruments", "Ophthalmic Goods",
        "Pharmaceutical Preparations", "Services – Research, Development, Testing Labs", "Services –\xa0Health", "Surgical, Medical, And Dental Instruments And Supplies",
        "Wholesale – Drugs & Drug Proprietaries", "Wholesale – Medical, Dental & Hospital Equipment",
    ],
    "financials": [
        "Financial Services", "Fire, Marine & Casualty Insurance", "Insurance Agents, Brokers & Service", "Life Insurance", "Misc. Insurance Carriers", "National Commercial Banks",
        "Security And Commodity Brokers, Dealers, Exchanges & Services", "State Commercial Banks – Fed Reserve System",
    ],
    "energy": [
        "Crude Petroleum & Natural Gas", "Misc. Oil & Gas Field Services", "Natural Gas Transmission", "Natural Gas Transmission & Distribution", "Oil & Gas Field Machinery & Equipment",
        "Oil Royalty Traders", "Petroleum Refining",
    ],
    "industrials": [
        "Air Conditioning, Warm Air Heating And Refrigeration Equipment", "Air Transportation", "Aircraft", "Aircraft & Parts", "Aircraft Engines & Engine Parts",
        "Arrangement Of Transportation Of Freight And Cargo", "Automatic Controls For Regulating Residential & Commercial Environments & Appliances ", "Construction Machinery & Equipment",
        "Construction – Special Contractors", "Construction, Mining & Material Handling Machinery & Equipment", "Cutlery, Hand Tools And General Hardware", "Electrical Industrial Apparatus",
        "Electronic & Other Electrical Equipment", "Engines & Turbines", "Farm And Garden Machinery And Equipment", "General Industrial Machinery & Equipment",
        "Guided Missiles And Space Vehicles And Parts", "Heating Equipment & Plumbing Fixtures", "Heavy Construction – Not Building Contractors", "Household Appliances",
        "Industrial Measurement Instruments & Related Products", "Misc. Aircraft Parts & Auxiliary Equipment", "Misc. Fabricated Metal Products",
        "Misc. Industrial And Commercial Equipment And Machinery", "Misc. Measuring And Controlling Devices", "Misc. Publishing", "Ordnance & Accessories", "Railroad Equipment",
        "Railroads, Line-Haul Operating", "Rolling, Drawing & Extruding Of Nonferrous Metals", "Search, Detection, Navigation, Guidance",
        "Services – Computer Processing, Data Preparation And Processing", "Services – Consumer Credit Reporting Agencies, Collection Services",
        "Services – Engineering, Accounting, Research, Management", "Services – Equipment Rental And Leasing", "Services – Misc. Business Services", "Services – Sanitary Services",
        "Services – Security", "Ship Building And Repairing", "Trucking & Courier Services, Except Air", "Wholesale – Durable Goods", "Wholesale – Hardware, Plumbing & Heating Equipment",
    ],
    "materials": [
        "Agricultural Production – Crops", "Agriculture Chemicals", "Blast Furnaces & Steel Works", "Cement, Hydraulic", "Gold & Silver Ores", "Industrial Inorganic Chemicals",
        "Industrial Organic Chemicals", "Metal Cans And Shipping Containers", "Metal Mining", "Mining And Quarrying Nonmetallic Minerals", "Misc. Manufacturing Industries", "Paints",
        "Paper And Allied Products", "Paperboard Containers, Boxes, Drums, Tubs", "Plastic Material & Synthetic Resin/Rubber",
    ],
    "consumer_staples": [
        "Beverages", "Bottled-Canned Soft Drinks", "Canned & Preserved Fruits & Vegetables", "Fats And Oils", "Flour And Other Grain Mill Products", "Food And Kindred Products", "Meat Products",
        "Misc. Food Preparations And Kindred Products", "Perfumes, Cosmetics And Other Toilet Preparations", "Retail – Drug & Proprietary Stores", "Retail – Grocery Stores",
        "Retail – Variety Stores", "Soap & Other Detergents", "Sugar And Confectionery Products", "Tobacco Products", "Wholesale – Groceries & Related Products",
    ],
    "consumer_discretionary": [
        "Apparel And Other Finished Products", "General Building Contractors – Residential", "Hotels & Motels", "Leather Tanning And Finishing", "Motor Vehicle Parts & Accessories",
        "Motor Vehicles & Passenger Car Bodies", "Operative Builders", "Retail – Apparel & Accessory Stores", "Retail – Automotive And Home Supply Stores",
        "Retail – Automotive Dealers And Gas Stations", "Retail – Eating Places", "Retail – Home Furniture And Equipment Stores", "Retail – Lumber & Other Building Materials",
        "Retail – Misc. Retail Stores", "Retail – Non-Store Retailers (Catalogs, Etc.)", "Retail – Radio, Tv And Consumer Electronic Stores",
        "Retail – Retail-Building Materials, Hardware, Garden Supply", "Rubber And Plastics Footwear", "Services – Services To Dwellings & Other Buildings",
        "Services –\xa0Amusement And Recreation", "Toys", "Transportation Services", "Water Transport", "Wholesale – Automotive Vehicles & Automotive Parts & Supplies",
    ],
    "telecommunication": [
        "Cable And Other Pay Tv Services", "Misc. Communication Services", "Newspapers –\xa0Publishing-Printing", "Radio & Tv Broadcasters", "Services – Advertising",
        "Services –\xa0Misc. Entertainment", "Services –\xa0Video Rental", "Telephone Communications",
    ],
    "utilities": ["Cogeneration – Sm Power Producer", "Electric And Other Services Combined", "Electric Services", "Gas And Other Services Combined", "Natural Gas Distribution", "Water Supply"],
    "real_estate": ["REIT", "Real Estate", "Real Estate Operators And Lessors"],
}


def sector_groups(spark: SparkSession) -> DataFrame:
    """group, sector."""
    return spark.createDataFrame([(g, s) for s, groups in SECTOR_GROUPS.items() for g in groups], "group string, sector string")
