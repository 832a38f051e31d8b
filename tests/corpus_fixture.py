"""A small contract written for these tests."""

PAGES = {
    1: "ARTICLE 1\nDefinitions\n1.1 General Terms\n\"Work\" means all labor, equipment and services that the Contractor performs under this agreement.\n\"Delay Event\" shall mean an event outside the reasonable control of a party.",
    2: "ARTICLE 2\nScope of Work\n2.1 Permits and Approvals\nThe Contractor shall obtain the building permit and all construction approvals. The Owner is responsible for the air permit.\n2.2 Payment of Costs\nOwner shall pay each invoice within thirty days after receipt. Late payments bear interest at two percent above the base rate.",
    3: "ARTICLE 3\nEquipment\n3.1 Condensate Transfer Pump\nContractor shall furnish two condensate transfer pumps in a 2 x 100% configuration.\nThe condensate transfer pump motor shall be rated at 75 HP.\nCondensate Transfer Pump | Capacity | 450 gpm\n3.2 Fuel Gas Heater\nThe fuel gas heater shall be model FGH220 for continuous service. The design pressure of the fuel gas heater shall be 600 psig.",
    4: "3.3 Instrument Air Compressor\nDesign Conditions\nCharacteristic\nValue\nRated flow\n350 scfm\nDischarge pressure\n125 psig\nMotor power\n150 hp\n3.4 Spare Parts\n- Two mechanical seals for each pump\n- One motor bearing set\n- Four filter elements\n- One set of gaskets",
    5: "EXHIBIT B\nEmission Guarantees\nNOx emissions shall not exceed 2.0 ppmvd at 15 percent oxygen. CO emissions shall not exceed 4.0 ppmvd at full load.\nARTICLE 4\nSchedule and Delay\n4.1 Liquidated Damages\nIf substantial completion is late, Contractor shall pay delay liquidated damages of 50,000 dollars for each day of delay.\n4.2 Termination for Convenience\nOwner may terminate this agreement for convenience by notice. Contractor shall be paid for Work performed before termination.",
}

QUESTIONS = {
    "config": ("What is the configuration of the condensate transfer pumps?", "2 x 100%"),
    "capacity": ("What is the capacity of the condensate transfer pump?", "450 gpm"),
    "power": ("What is the power of the condensate transfer pump motor?", "75 HP"),
    "model": ("What model is the fuel gas heater?", "FGH220"),
    "pressure": ("What is the design pressure of the fuel gas heater?", "600 psig"),
    "permit": ("Who is responsible for the air permit?", "Owner is responsible for the air permit"),
    "late": ("What happens if the contractor finishes late?", "liquidated damages"),
    "terminate": ("Can the owner terminate for convenience?", "terminate this agreement for convenience"),
    "emissions": ("What are the emission guarantees?", "2.0 ppmvd"),
    "section": ("Section 4.1", "liquidated damages"),
    "define": ("Define delay event", "outside the reasonable control"),
    "quote": ("Show me late payments", "two percent above the base rate"),
}
UNKNOWN = {
    "helicopter": "What is the capacity of the helicopter landing pad?",
    "dragon": "Who feeds the dragon?",
    "nosection": "Section 9.9",
}


def pages(spark, document_id="doc_t"):
    return spark.createDataFrame([(document_id, n, t) for n, t in PAGES.items()], "document_id string, page_num int, page_text string")
